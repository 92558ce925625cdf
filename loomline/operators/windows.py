"""Rankings, best-per-key, rates, rolling moments, islands and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.counters import threefry
from loomline.session import written


def micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(F.col(at).cast("timestamp"))


def competition_rank(keys: list[str], order: list[Column]) -> Column:
    """Equal rows share the first place, and the next one skips."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(*order))


def strict_rank(keys: list[str], order: list[Column], tiebreak: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *tiebreak))


def best_per_key(df: DataFrame, key: str, owner: str, value: str, most: int) -> DataFrame:
    """Per key the `most` owners with the least value, each owner once by its best."""
    best = df.groupBy(key, owner).agg(F.min(value).alias(value))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(value, owner))).where(F.col("place") <= most)


def counter_rate(value: str, at: str, keys: list[str], tiebreak: str) -> Column:
    """Increase per second since the row before; 0 where the counter was reset, null without a row before or time between."""
    w = Window.partitionBy(*keys).orderBy(at, tiebreak)
    dt = micros(at) - F.lag(micros(at)).over(w)
    return F.when(dt > 0, F.greatest(F.lit(0.0), F.col(value) - F.lag(value).over(w)) * 1e6 / dt)


def trailing_sum(value: Column, at: str, keys: list[str], seconds: int) -> Column:
    """Over the rows of the last `seconds`, those at the same instant included."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(micros(at)).rangeBetween(-seconds * 1_000_000, 0))


def rolling(value: str, keys: list[str], order: list[str], rows: int) -> tuple[Column, Column]:
    """Mean and population variance of the last `rows` rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return F.avg(value).over(w), F.var_pop(value).over(w)


def islands(df: DataFrame, key: str, start: Column, end: Column, gap: Column | None = None) -> DataFrame:
    """Touching or overlapping intervals of a key joined: key, island, start, end, n."""
    rows = df.select(F.col(key), start.alias("s"), end.alias("e"))
    w = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("s") > reach)).cast("int")
    marked = rows.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.count("*").alias("n"))


def route(scores: DataFrame, token: str, expert: str, score: str, k: int, slots: int) -> DataFrame:
    """Each token's k best experts; an expert takes its first `slots` tokens in order."""
    top = scores.withColumn("choice", F.row_number().over(Window.partitionBy(token).orderBy(F.desc(score), expert))).where(F.col("choice") <= k)
    return top.withColumn("slot", F.row_number().over(Window.partitionBy(expert).orderBy(token)) - 1).where(F.col("slot") < slots)


def steps_of(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Neighbouring values per key: from, to."""
    return df.select(key, F.col(value).alias("from"), F.lead(value).over(Window.partitionBy(key).orderBy(order)).alias("to")).where(F.col("to").isNotNull())


def global_places(df: DataFrame, order: list[str], kept: Column) -> DataFrame:
    """df with place, from 0, in the whole order, and kept_before, how many of the kept rows come before.

    Range partitions are numbered each by its own task, and what precedes a partition is summed over a row per partition.
    The partitions are written first, so that a lost executor deals no row anew. Null kept counts as false; equal rows are placed in any order.
    """
    one = F.coalesce(kept, F.lit(False)).cast("long")
    rows = written(df.withColumn("_one", one).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "places")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = rows.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_one").alias("k"))
    sums = sums.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("_k"))
    within = Window.partitionBy("_part").orderBy(*order)
    before = F.sum("_one").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_one")
    placed = rows.withColumns({"place": F.row_number().over(within) - 1, "kept_before": before}).join(sums, "_part")
    return placed.withColumns({"place": F.col("place") + F.col("_n"), "kept_before": F.col("kept_before") + F.col("_k")}).drop("_one", "_part", "_n", "_k")


def running_sums(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """df with <s>_to for each of sums: its sum over all rows up to and with this one, in the whole order, which no two rows share.

    Two levels, as in global_places: each range partition adds up its own rows, and what precedes a partition is summed over a row per partition.
    """
    rows = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = rows.groupBy("_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumns({f"{s}_to": F.sum(s).over(within) for s in sums}).join(totals, "_part")
    return told.withColumns({f"{s}_to": F.col(f"{s}_to") + F.col(f"_{s}") for s in sums}).drop("_part", *[f"_{s}" for s in sums])


def shuffled(df: DataFrame, ident: str, key: tuple[int, int, int, int], draw: int = 0) -> DataFrame:
    """df with place, from 0: its rows in a random order that depends on the key, the number of the draw and the rows' whole-number ids alone, not on how they lie.

    A row is placed by its own random words, so the order takes one sort by range; rows with the same id, or without one, stand in any order among each other.
    """
    words = threefry([F.coalesce(F.col(ident), F.lit(-1)), F.lit(draw), F.lit(0), F.lit(0)], key)
    rows = df.withColumn("_w", words).withColumns({"_w0": F.col("_w")[0], "_w1": F.col("_w")[1]}).drop("_w")
    return global_places(rows, ["_w0", "_w1"], F.lit(False)).drop("_w0", "_w1", "kept_before")


def _named(df: DataFrame, order: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_o{k}" for k in range(len(order))]
    return df.withColumns(dict(zip(names, order))), names


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & a[c].eqNullSafe(b[f"{c}_b"])
    return out


def ranks(df: DataFrame, keys: list[str], order: list[Column], falling: bool = False) -> DataFrame:
    """df with place: equal rows share the first place of a key, and the next one skips. A key's rows may lie on any number of tasks.

    Rows are counted by key and value, the counts are added up in order over range partitions, and each row meets its value's place in a join. Nulls come first, or last if falling.
    """
    rows, names = _named(df, order)
    counts = rows.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    told = written(running_sums(counts, [*keys, *[F.desc(c) if falling else F.asc(c) for c in names]], ["_n"]), "ranks")
    first = told.groupBy(*keys).agg(F.min(F.col("_n_to") - F.col("_n")).alias("_first")).withColumnsRenamed({k: f"{k}_b" for k in keys})
    values = told.join(first, _same(told, first, keys)).select(*[F.col(c).alias(f"{c}_b") for c in [*keys, *names]], (F.col("_n_to") - F.col("_n") - F.col("_first") + 1).alias("place"))
    values = written(values, "places")
    return rows.join(values, _same(rows, values, [*keys, *names])).select(*df.columns, "place")


def strict_ranks(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """df with place: 1, 2, ... within each key by an order that tells its rows apart; a key's rows may lie on any number of tasks."""
    placed = written(global_places(df, [*keys, *order], F.lit(False)), "strict")
    first = placed.groupBy(*keys).agg(F.min("place").alias("_first")).withColumnsRenamed({k: f"{k}_b" for k in keys})
    return placed.join(first, _same(placed, first, keys)).select(*df.columns, (F.col("place") - F.col("_first") + 1).alias("place"))


def percentiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, p0, p1, ...): for each share, the value at that place of a key's values in order, between two of them in proportion. Nulls do not count. No task holds a key's values."""
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy("key", "v").agg(F.count("*").alias("n"))
    told = written(running_sums(rows, ["key", "v"], ["n"]), "percentiles")
    ends = told.groupBy("key").agg(F.min(F.col("n_to") - F.col("n")).alias("first"), F.max("n_to").alias("last")).withColumnRenamed("key", "key_b")
    placed = told.join(ends, told["key"].eqNullSafe(ends["key_b"])).withColumns({"from": F.col("n_to") - F.col("n") - F.col("first"), "to": F.col("n_to") - F.col("first")})
    picks = []
    for k, share in enumerate(shares):
        at = (F.col("last") - F.col("first") - 1) * share
        holds = lambda c: (c >= F.col("from")) & (c < F.col("to"))
        low, part = F.floor(at), at - F.floor(at)
        picks.append((F.max(F.when(holds(low), F.col("v") * (1 - part))) + F.max(F.when(holds(F.least(low + 1, F.col("last") - F.col("first") - 1)), F.col("v") * part))).alias(f"p{k}"))
    return placed.groupBy("key").agg(*picks)


def rolling_over(df: DataFrame, value: str, keys: list[str], order: list[str], rows: int, bucket: int = 1 << 20) -> DataFrame:
    """df with mean and variance (of the population) of the last `rows` rows of its key, this one included.

    Rows are numbered in the order of keys and `order` and dealt to buckets of that many; the last ones of a bucket are dealt to the next one too, where they are only
    looked back at. So a key's rows are as many tasks as they fill.
    """
    placed = written(global_places(df, [*keys, *order], F.lit(False)).drop("kept_before"), "rolling")
    own, last = F.expr(f"place div {bucket}"), F.col("place") % bucket >= bucket - (rows - 1)
    dealt = placed.withColumn("_b", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("_b", *keys).orderBy("place").rowsBetween(-(rows - 1), 0)
    told = dealt.withColumns({"mean": F.avg(value).over(w), "variance": F.var_pop(value).over(w)})
    return told.where(F.col("_b") == own).drop("_b", "place")
