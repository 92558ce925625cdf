"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents, in an order seeded by a digest of their ids, form a stream of words that is cut
into blocks of equal size. Seats (blocks) go to the sources by the highest quotients target / (2k - 1);
as that sequence of seats only grows, its runs give each output shard integer quotas, and a source's
quotas take its blocks in seeded order, starting again when all are taken, twice at most.

Null texts have no words, and a null source is a source of its own, last in order. Rows that are equal
may share their words in either order. Without any words every target is zero. Weights are whole numbers.
"""

from __future__ import annotations

import math
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import WORD, if_small, lean_batches, read_documents
from loomline.session import written

WEIGHTS, SHARE_PERCENT, MOST_EPOCHS, SEED = (5, 2, 1), 150, 2, "mix-1"
#: The largest block in words; less if a source's target is under 100 such blocks.
MAX_BLOCK = 1024
#: Rows of a source's stream that one window sorts.
ROWS_PER_BUCKET = 20_000
BROADCAST_SOURCES = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From rows (source, size): a row per source with source_size, weight and target in words.

    The share is water-filled in one pass: in ascending order of cap / weight, a source is held at
    its cap as long as the rest, shared by weight, would lift it above. The sums are of integers, exact.
    """
    unit = math.lcm(*weights)
    pos = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))  # a row per source from here on
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (pos + 1).cast("int")).cast("long"))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") * (F.lit(unit) / F.col("weight")).cast("long"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * MOST_EPOCHS
    by = by.withColumns({
        "cap": cap,
        "at": F.row_number().over(order),
        "left": F.sum("source_size").over(whole) * SHARE_PERCENT - 100 * F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    free = F.when(100 * F.col("cap") * F.col("left_weight") > F.col("weight") * F.col("left"), F.struct("at", "left", "left_weight"))
    by = by.withColumn("free", F.min(free).over(whole))
    shared = (F.col("weight") * F.col("free.left")).cast("double") / (100 * F.col("free.left_weight")).cast("double")
    return by.select("source", "source_size", "weight", F.when(F.col("free").isNull() | (F.col("at") < F.col("free.at")), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def quotas(sources: DataFrame, shards: int = 16, max_block: int = MAX_BLOCK) -> DataFrame:
    """A row (shard, source, quota, block) per shard and source: whole blocks of `block` words by highest quotients.

    Sainte-Laguë seats are rounded multiples of a common divisor, so a source's seats differ from its
    proportional share by its part of half the number of sources, and one; quotients are ranked only within that reach.
    """
    sums = sources.agg(F.sum("target").alias("t"), F.count("*").alias("k"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("low"))
    sums = sums.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(F.coalesce("low", F.lit(1.0)) / 100))).cast("long"))
    sums = sums.withColumn("seats", F.round(F.col("t") / F.col("block")).cast("long"))
    ends = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")).withColumn("upto", F.floor(F.col("seats") * F.col("shard") / shards))
    each = sources.select("source", "target").crossJoin(F.broadcast(ends)).withColumn("share", F.when(F.col("t") > 0, F.col("target") * F.col("upto") / F.col("t")).otherwise(0.0))
    reach = F.ceil(F.when(F.col("upto") > 0, F.col("k") * F.col("share") / (2 * F.col("upto"))).otherwise(0.0)) + 1
    each = each.withColumn("sure", F.greatest(F.lit(0), F.floor("share") - reach)).withColumn("upper", F.ceil("share") + reach)
    rest = each.select("shard", "source", "target", "upto", "sure", F.explode(F.sequence(F.col("sure") + 1, F.col("upper"))).alias("seat"))
    rest = rest.where("target > 0").withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
    sure = each.groupBy("shard").agg(F.sum(F.when(F.col("target") > 0, F.col("sure"))).alias("given"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("quotient"), F.col("source").asc_nulls_last()))
    won = rest.withColumn("place", place).join(sure, "shard").where("place <= upto - given").groupBy("shard", "source").agg(F.count("*").alias("won"))
    total = each.alias("e").join(won.alias("w"), (F.col("e.shard") == F.col("w.shard")) & F.col("e.source").eqNullSafe(F.col("w.source")), "left")
    total = total.select("e.shard", "e.source", "e.block", F.when(F.col("target") > 0, F.col("sure") + F.coalesce("won", F.lit(0))).otherwise(F.lit(0)).alias("upto"))
    earlier = F.lag("upto", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return total.select("shard", "source", (F.col("upto") - earlier).alias("quota"), "block")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, shards: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row, and the columns named in keep.

    taken is the words that the mix takes of the document, repeats counted: as often as its source's
    stream is taken whole, and where the last, partial pass reaches it.
    Sums run in two levels, over buckets of a source's stream and within each, so no task holds a whole source.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = lean_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
    rows = written(rows, "mix-sizes")
    by = written(targets(rows), "mix-targets")
    seats = quotas(by, shards).groupBy("source").agg(F.sum(F.col("quota") * F.col("block")).alias("words"))
    won = by.alias("b").join(seats.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    words = F.least(F.col("words"), F.col("source_size") * MOST_EPOCHS)
    won = won.select(F.col("b.source").alias("of"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).alias("whole"), F.when(F.col("source_size") > 0, words % F.col("source_size")).otherwise(0).alias("part"))
    won = if_small(written(won, "mix-won"), BROADCAST_SOURCES)

    buckets = max(1, math.ceil(rows.count() / ROWS_PER_BUCKET))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    rows = rows.withColumn("digest", digest).withColumn("bucket", F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets, 32))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("in"), base.alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["of"]) & (rows["bucket"] == sums["in"])).drop("of", "in")
    rows = rows.join(won, rows["source"].eqNullSafe(won["of"])).drop("of")
    start = F.col("base") + F.col("inner")
    extra = F.greatest(F.lit(0), F.least(F.col("part"), start + F.col("size")) - start)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _portions(text: pa.Array, size: pa.Array, taken: pa.Array) -> pa.Array:
    """The whole text as often as all its words are taken, and its first words for the rest."""
    out = []
    for x, n, t in zip(text.to_pylist(), size.to_pylist(), taken.to_pylist()):
        whole, part = divmod(t, n) if n else (0, 0)
        rows = [x] * whole
        if part:
            rows.append(x[: next(islice(re.finditer(WORD, x), part - 1, None)).end()])
        out.append(rows)
    return pa.array(out, pa.list_(pa.string()))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row per whole pass, and one with the first words where the last pass ends inside the text; rows without taken words go."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    named = lambda i, s, n: [F.coalesce(i.cast("string"), F.lit("")).alias("m_id"), F.coalesce(F.concat(F.lit("="), s), F.lit("")).alias("m_source"), n.alias("m_size")]
    mixed = mix(docs, id_col, text_col, source_col).select(*named(F.col("doc_id"), F.col("source"), F.col("size")), "taken")
    keys = ["m_id", "m_source", "m_size"]
    one = Window.partitionBy(*keys)  # rows with equal id, source and size: told apart by a number
    mixed = mixed.withColumn("m_k", F.row_number().over(one.orderBy("taken")))
    rows = lean_batches(docs).select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("m_text"), *named(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), size))
    rows = rows.withColumn("m_k", F.row_number().over(one.orderBy(F.xxhash64("m_text"))))
    rows = rows.join(mixed, [*keys, "m_k"]).where("taken > 0").withColumn("m_new", F.explode(_portions("m_text", "m_size", "taken")))
    return rows.select(*[(F.col("m_new") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: The rows of mix() for one shard: quotas per shard add up to those.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('{SEED}:' || doc_id) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER w AS pos, 150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw
      FROM s WINDOW w AS (ORDER BY source_size * (10 // weight), source NULLS LAST)),
f AS (SELECT * FROM o WHERE 200 * source_size * lw > weight * lft ORDER BY pos LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN f.pos IS NULL OR o.pos < f.pos THEN (2 * o.source_size)::DOUBLE
             ELSE (o.weight * f.lft)::DOUBLE / (100 * f.lw)::DOUBLE END AS target FROM o LEFT JOIN f ON true),
n AS (SELECT *, round(total / block)::BIGINT AS seats FROM (SELECT sum(target) AS total, count(*) AS k,
             greatest(1, least({MAX_BLOCK}, floor(min(target) FILTER (target > 0) / 100)))::BIGINT AS block FROM t)),
q AS (SELECT source, target / (2 * seat - 1) AS quotient, n.seats FROM (SELECT t.source, t.target,
             unnest(range(1, ceil(t.target * n.seats / n.total)::BIGINT + n.k + 2)) AS seat FROM t, n WHERE t.target > 0), n),
won AS (SELECT source, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST) AS place FROM q) WHERE place <= seats GROUP BY source),
g AS (SELECT t.*, least(coalesce(blocks, 0) * block, 2 * source_size)::BIGINT AS words FROM t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source, n),
r AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.words // g.source_size ELSE 0 END AS whole,
             CASE WHEN g.source_size > 0 THEN g.words % g.source_size ELSE 0 END AS part,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(part, start + size) - start))::BIGINT AS taken FROM r
"""
