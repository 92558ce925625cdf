"""Best choices of edges: least spanning arborescences and greatest bipartite matchings, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.graphs import bfs
from loomline.session import Scratch, written


def _on_cycles(best: DataFrame, label: str) -> DataFrame:
    """(v, ring) of the nodes that following (v, u) from v to u leads back to; ring is the least node of the cycle.

    After as many doublings as the nodes need, each node points somewhere on its cycle, or has gone, as what leads to no u does.
    """
    spark = best.sparkSession
    n, old = best.count(), Scratch(spark)
    now = old.written(best.select("v", F.col("u").alias("to"), F.col("v").alias("least")), label)
    for _ in range(max(1, n).bit_length()):
        there = now.select(F.col("v").alias("to"), F.col("to").alias("far"), F.col("least").alias("other"))
        new = Scratch(spark)
        now = new.written(now.join(there, "to").select("v", F.col("far").alias("to"), F.least("least", "other").alias("least")), label)
        old.drop()
        old = new
        if not now.head(1):
            break
    out = written(now.join(now.select(F.col("to").alias("v")).distinct(), "v", "left_semi").select("v", F.col("least").alias("ring")), label)
    old.drop()
    return out


def arborescence(edges: DataFrame, root: int) -> DataFrame:
    """(node, src, weight, reached): for every node but the root, the edge that enters it in a spanning arborescence of least weight over edges (src, dst, weight).

    Nodes that the root does not reach come with reached false and no edge. Of parallel edges the least counts; loops, edges into the root and rows with a
    null are left out. In each round every node takes its least entering edge (ties: the least source); each cycle of those becomes a node, into which an edge
    costs what it costs beyond the one that it replaces; rounds end without a cycle, and are then undone from the last to the first.
    """
    spark = edges.sparkSession
    real = edges.dropna(subset=["src", "dst", "weight"])
    nodes = real.select(F.col("src").alias("node")).union(real.select("dst")).distinct().where(F.col("node") != root)
    reached = bfs(real, spark.range(1).select(F.lit(root).cast("long").alias("node"))).select("node")
    with Scratch(spark) as tables:
        own = real.where((F.col("src") != F.col("dst")) & (F.col("dst") != root)).join(reached, F.col("src") == F.col("node"), "left_semi")
        first = tables.written(own.groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.min("weight").cast("double").alias("w")), "arcs")
        now, stack = first.select("u", "v", "w", F.col("u").alias("pu"), F.col("v").alias("pv")), []
        while True:
            best = tables.written(now.groupBy("v").agg(F.min(F.struct("w", "u")).alias("b")).select("v", "b.u", "b.w"), "best")
            rings = _on_cycles(best, "rings")
            stack.append((now, best))
            if not rings.head(1):
                break
            r = lambda k: rings.select(F.col("v").alias(k), F.col("ring").alias(f"{k}_ring"))  # noqa: B023, E731
            less = best.select("v", F.col("w").alias("less"))
            joined = now.join(r("u"), "u", "left").join(r("v"), "v", "left").join(less, "v")
            met = joined.select(F.coalesce("u_ring", "u").alias("nu"), F.coalesce("v_ring", "v").alias("nv"), F.when(F.col("v_ring").isNotNull(), F.col("w") - F.col("less")).otherwise(F.col("w")).alias("nw"), F.col("u").alias("pu"), F.col("v").alias("pv"))
            met = met.where("nu <> nv").groupBy("nu", "nv").agg(F.min(F.struct("nw", "pu", "pv")).alias("e"))
            now = tables.written(met.select(F.col("nu").alias("u"), F.col("nv").alias("v"), F.col("e.nw").alias("w"), "e.pu", "e.pv"), "arcs")
        chosen = stack[-1][1].select("v", "u")
        for k in range(len(stack) - 1, 0, -1):
            arcs, below = stack[k][0], stack[k - 1][1]
            over = chosen.join(arcs, ["u", "v"]).select(F.col("pv").alias("v"), F.col("pu").alias("over"))
            chosen = tables.written(below.join(over, "v", "left").select("v", F.coalesce("over", "u").alias("u")), "chosen")
        told = chosen.join(first, ["u", "v"]).select(F.col("v").alias("node"), F.col("u").alias("src"), F.col("w").alias("weight"))
        return written(nodes.join(told, "node", "left").withColumn("reached", F.col("src").isNotNull()), "arborescence")


def matching(edges: DataFrame) -> DataFrame:
    """(src, dst) of a greatest matching of a bipartite graph with sources src on one side and dst on the other: no node comes twice, and no matching has more rows.

    A phase grows a forest of alternating ways from all free sources at once, each node hung on the least that reaches it; every tree with a free end gives one way,
    the shortest, and then that to the least end. Ways of different trees share no node, so all are turned at once. Without such an end the matching is greatest. Rows with a null are left out.
    """
    spark = edges.sparkSession
    with Scratch(spark) as tables:
        rows = tables.written(edges.select("src", "dst").dropna().distinct(), "pairs")
        matched = tables.written(rows.limit(0), "matched")
        while True:
            phase = Scratch(spark)
            mate = matched.select(F.col("src").alias("mate"), F.col("dst"))
            free = rows.select("src").distinct().join(matched, "src", "left_anti")
            front = phase.written(free.select("src", F.col("src").alias("tree")), "front")
            seen, ends, steps = None, [], []
            while front.head(1):
                way = front.join(rows, "src")
                if seen is not None:
                    way = way.join(seen, "dst", "left_anti")
                hung = phase.written(way.groupBy("dst").agg(F.min(F.struct("src", "tree")).alias("p")).select("dst", "p.src", "p.tree").join(mate, "dst", "left"), "hung")
                steps.append(hung)
                seen = hung.select("dst") if seen is None else seen.unionByName(hung.select("dst"))
                ends.append(hung.where("mate IS NULL").groupBy("tree").agg(F.min("dst").alias("dst")))
                front = phase.written(hung.where("mate IS NOT NULL").select(F.col("mate").alias("src"), "tree"), "front")
            if not steps:
                phase.drop()
                break
            turned, taken = [], None
            for end in ends:  # the shortest way of a tree counts
                new = end if taken is None else end.join(taken, "tree", "left_anti")
                turned.append(phase.written(new, "ends"))
                taken = turned[-1].select("tree") if taken is None else taken.unionByName(turned[-1].select("tree"))
            at, new_pairs = None, []
            for level in range(len(steps) - 1, -1, -1):
                at = turned[level].select("dst") if at is None else at.unionByName(turned[level].select("dst"))
                step = phase.written(steps[level].join(at, "dst", "left_semi").select("dst", "src"), "turn")
                new_pairs.append(step)
                at = matched.join(step.select("src"), "src", "left_semi").select("dst")  # what the source was matched with is where the way comes from
            pairs = new_pairs[0]
            for x in new_pairs[1:]:
                pairs = pairs.unionByName(x)
            if not pairs.head(1):
                phase.drop()
                break
            stay = matched.join(pairs.select("src"), "src", "left_anti")
            matched = tables.written(stay.select("src", "dst").unionByName(pairs.select("src", "dst")), "matched")
            phase.drop()
        return written(matched, "matching")
