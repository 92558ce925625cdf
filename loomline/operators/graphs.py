"""Graphs as edge tables: levels, closures, shortest paths, components, quotients and reductions.

Loops run on the driver, one round a step; each round is written to the shared folder, so plans do not grow and a
lost executor costs one round; a round's tables are deleted when the next ones stand. Only counts come back to the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import Scratch, scratch, written


def bfs(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(node, level) of every node reached from sources (column node) over edges (src, dst); raises where one is beyond level `most`. Each front is written once."""
    with Scratch(edges.sparkSession) as tables:
        edges = tables.written(edges.select("src", "dst"), "edges")
        seen = front = tables.written(sources.select("node", F.lit(0).cast("long").alias("level")).distinct(), "bfs")
        for level in count(1):
            step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
            front = tables.written(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level).cast("long")), "bfs")
            if not front.head(1):
                return written(seen, "bfs")
            if most is not None and level > most:
                raise ValueError(f"the graph has nodes beyond level {most}")
            seen = edges.sparkSession.read.schema(front.schema).parquet(*tables.paths[1:])


def shortest_paths(edges: DataFrame, source, most: int | None = None) -> DataFrame:
    """(node, dist) from one source over edges (src, dst, weight) with weights of 0 or more; raises where a shortest path has over `most` edges. What improves is written once."""
    spark = edges.sparkSession
    with Scratch(spark) as tables:
        edges = tables.written(edges.select("src", "dst", "weight"), "edges")
        dist = front = tables.written(spark.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0).cast("double").alias("dist")), "sssp")
        for length in count(1):
            step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("new")).groupBy("node").agg(F.min("new").alias("new"))
            front = step.join(dist, "node", "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist"))).select("node", F.col("new").alias("dist"))
            front = tables.written(front, "sssp")
            if not front.head(1):
                return written(dist, "sssp")
            if most is not None and length > most:
                raise ValueError(f"a shortest path has over {most} edges")
            dist = spark.read.schema(front.schema).parquet(*tables.paths[1:]).groupBy("node").agg(F.min("dist").alias("dist"))


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """All (src, dst) joined by a path, by doubling: after k rounds, paths of up to 2**k edges.

    A pair is kept with the edges of its shortest path. A round joins those of exactly `far` edges, the longest so far, with all: every pair that is
    up to twice as far apart comes from such a one, so no other pairs are joined again, and only what is new is written. A round without pairs of
    twice as many edges is the last.
    """
    spark, far = edges.sparkSession, 1
    paths = [scratch(spark, "closure")]
    edges.select("src", "dst").distinct().withColumn("far", F.lit(1).cast("long")).write.parquet(paths[0])
    reach = spark.read.parquet(*paths)
    for _ in range(most):
        longest = reach.where(F.col("far") == far)
        if not longest.head(1):
            break
        second = reach.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("far").alias("more"))
        steps = longest.join(second.hint("merge"), F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst"), (F.col("far") + F.col("more")).alias("far"))
        new = steps.groupBy("src", "dst").agg(F.min("far").alias("far"))
        paths.append(scratch(spark, "closure"))
        old = reach.select(F.col("src").alias("s"), F.col("dst").alias("d")).hint("merge")
        new.join(old, F.col("src").eqNullSafe(F.col("s")) & F.col("dst").eqNullSafe(F.col("d")), "left_anti").write.parquet(paths[-1])
        reach, far = spark.read.schema(reach.schema).parquet(*paths), 2 * far
    return reach.select("src", "dst")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (src, dst), component the least node.

    Alternates large-star and small-star steps over links from greater to lesser nodes; minima are aggregated before the shuffle, and no
    node gathers its neighbours. Nodes with loops alone are components of their own.
    """
    spark = edges.sparkSession
    old = Scratch(spark)
    pairs = old.written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    nodes, links, seen = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), pairs.where("u <> v"), None
    first, old = old, Scratch(spark)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = Scratch(spark)
        links = new.written(stars, "cc")
        old.drop()
        old = new
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    out = written(nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component")), "cc")
    old.drop()
    first.drop()
    return out


def quotient(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between classes (vertex, class) with the least delay of each."""
    a, b = (classes.select(F.col("vertex").alias(v), F.col("class").alias(c)) for v, c in (("src", "from_class"), ("dst", "to_class")))
    return edges.join(a, "src").join(b, "dst").where("from_class <> to_class").groupBy("from_class", "to_class").agg(F.min("delay").alias("delay"))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph: 0 without predecessors, else one more than the highest of them. A cycle raises.

    Each round takes off the nodes that no edge left enters, so a node goes in the round of its level; where edges are left but no such node, there is a cycle.
    """
    spark, at = edges.sparkSession, scratch(edges.sparkSession, "levels")
    old = Scratch(spark)
    left = old.written(edges.select("src", "dst").distinct(), "levels")
    nodes = old.written(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct(), "level-nodes")
    for level in count():
        new = Scratch(spark)
        stay = new.written(nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi"), "level-nodes")
        gone = new.written(nodes.join(stay, "node", "left_anti"), "level")
        gone.select("node", F.lit(level).cast("long").alias("level")).write.mode("append").parquet(at)
        if not gone.head(1) and stay.head(1):
            raise ValueError("the graph has a cycle")
        left = new.written(left.join(gone, left["src"] == gone["node"], "left_anti"), "levels")
        old.drop()
        old, nodes = new, stay
        if not nodes.head(1):
            break
    old.drop()
    return spark.read.schema(gone.withColumn("level", F.lit(0).cast("long")).schema).parquet(at)


def redundant_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) of an acyclic graph that a path of two edges or more implies.

    Only edges that span two levels or more, from a node with other ways on to one with other ways in, can be; for each of those the
    nodes below its head's level are walked from its tail, until the head is met.
    """
    spark, level = edges.sparkSession, levels(edges)
    a, b = (level.select(F.col("node").alias(k), F.col("level").alias(f"{k}_level")) for k in ("src", "dst"))
    old = Scratch(spark)
    told = written(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst"), "edges")
    many = lambda k: told.groupBy(k).count().where("count > 1").select(k)
    asked = told.where("dst_level > src_level + 1").join(many("src"), "src", "left_semi").join(many("dst"), "dst", "left_semi")
    hop = told.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("dst_level").alias("next_level"))
    seen = front = old.written(asked.select("src", "dst", F.col("dst_level").alias("end"), F.col("src").alias("at")), "walk")
    found = []
    while front.head(1):
        new = Scratch(spark)
        ways = new.written(front.join(hop, "at").where((F.col("next_level") < F.col("end")) | ((F.col("next") == F.col("dst")) & (F.col("at") != F.col("src")))).select("src", "dst", "end", F.col("next").alias("at")).distinct(), "ways")
        found.append(written(ways.where("at = dst").select("src", "dst"), "redundant"))
        open_ = ways.where("at <> dst").join(found[-1], ["src", "dst"], "left_anti")
        front = new.written(open_.join(seen, ["src", "dst", "at"], "left_anti"), "walk")
        seen = new.written(seen.join(found[-1], ["src", "dst"], "left_anti").unionByName(front), "walk")
        old.drop()
        old = new
    old.drop()
    out = told.select("src", "dst").limit(0)
    for x in found:
        out = out.unionByName(x)
    return out.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in_")))
    return ends.groupBy("node").agg(F.sum("out").alias("out_degree"), F.sum("in_").alias("in_degree"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of a directed graph: two nodes share a component where each reaches the other; its name is the least node.

    Nodes that no edge enters or none leaves are taken off. Then every node learns the least node that reaches it; those that
    reach that one back among nodes of the same label are its component, and go. No pair of nodes is kept but the edges.
    """
    spark = edges.sparkSession
    every = edges.select("src", "dst").distinct()
    nodes = every.select(F.col("src").alias("node")).union(every.select("dst")).distinct()
    old, parts = Scratch(spark), []
    left = old.written(every.where("src <> dst"), "scc")
    while left.head(1):
        new = Scratch(spark)
        while True:  # take off what cannot lie on a cycle
            before = left.count()
            left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            left = new.written(left, "scc")
            if left.count() == before:
                break
        if not before:
            new.drop()
            break
        label = new.written(_spread(left, left.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()), "labels")
        a, b = (label.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label")) for k in ("src", "dst"))
        within = new.written(left.join(a, "src").join(b, "dst").where("src_label = dst_label").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src_label").alias("label")), "within")
        found = bfs(within, label.where("node = label").select("node"))  # backwards, inside one label each
        parts.append(written(label.join(found, "node", "left_semi").select("node", F.col("label").alias("component")), "scc-found"))
        gone = parts[-1].select("node")
        rest = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # no cycle leaves a label
        left = new.written(rest.join(gone, F.col("src") == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti"), "scc")
        old.drop()
        old = new
    old.drop()
    out = nodes.select("node", F.col("node").alias("component"))
    if parts:
        all_ = parts[0]
        for x in parts[1:]:
            all_ = all_.unionByName(x)
        out = nodes.join(all_, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return written(out, "scc")


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(node, label): the least label of the nodes that reach each node, its own included, over edges (src, dst); what fell in a round goes on in the next."""
    old = Scratch(edges.sparkSession)
    label = front = old.written(label, "spread")
    while True:
        new = Scratch(edges.sparkSession)
        heard = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("at")).agg(F.min("label").alias("heard"))
        both = new.written(label.join(heard, label["node"] == heard["at"], "left").select("node", F.least("label", "heard").alias("label"), F.coalesce(F.col("heard") < F.col("label"), F.lit(False)).alias("fell")), "spread")
        label, front = both.select("node", "label"), both.where("fell").select("node", "label")
        if not front.head(1):
            out = written(label, "spread")
            old.drop()
            new.drop()
            return out
        old.drop()
        old = new


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) between the nodes that stay when those of gone (node) are eliminated: what led through any number of them leads past them, at the least sum.

    From each node that stays, least sums spread over the eliminated nodes alone, round by round, as long as one falls; weights
    are 0 or more. Loops that arise are left out.
    """
    spark = edges.sparkSession
    with Scratch(spark) as tables:
        g = tables.written(gone.select("node").distinct(), "gone")
        is_gone = lambda df, k: df.join(g, df[k] == g["node"], "left").withColumn(f"{k}_gone", F.col("node").isNotNull()).drop("node")
        told = tables.written(is_gone(is_gone(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "src"), "dst"), "edges")
        inner = told.where("src_gone").select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("weight").alias("more"), "dst_gone")
        best = front = tables.written(told.where("NOT src_gone AND dst_gone").select("src", F.col("dst").alias("at"), "weight"), "past")
        paths = [tables.paths[-1]]
        while front.head(1):
            step = front.join(inner.where("dst_gone"), "at").select("src", F.col("to").alias("at"), (F.col("weight") + F.col("more")).alias("new")).groupBy("src", "at").agg(F.min("new").alias("new"))
            front = tables.written(step.join(best, ["src", "at"], "left").where("weight IS NULL OR new < weight").select("src", "at", F.col("new").alias("weight")), "past")
            paths.append(tables.paths[-1])
            best = spark.read.schema(front.schema).parquet(*paths).groupBy("src", "at").agg(F.min("weight").alias("weight"))
        past = best.join(inner.where("NOT dst_gone"), "at").select("src", F.col("to").alias("dst"), (F.col("weight") + F.col("more")).alias("weight"))
        rest = told.where("NOT src_gone AND NOT dst_gone").select("src", "dst", "weight").unionByName(past)
        return written(rest.where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")), "eliminated")
