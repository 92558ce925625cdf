"""Sets of intervals by a sweep over their end points: unions, what they cover of other intervals, and counts of pairs that are never made.

End points are added up by place before they are sorted, so a place that many intervals share is one row, and sorted by range,
so one key's places spread over many tasks. Intervals are half-open, [start, end); those that are empty, or lack a key or
an end, count as none. Touching and nested intervals of a union become one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.windows import running_sums
from loomline.session import written


def _real(df: DataFrame, key: str | None, start: str, end: str) -> DataFrame:
    k = F.col(key) if key else F.lit(0)
    return df.select(k.alias("key"), F.col(start).alias("s"), F.col(end).alias("e")).where("key IS NOT NULL AND s < e")


def union_of(df: DataFrame, key: str | None, start: str, end: str) -> DataFrame:
    """(key, number, start, end) of the fewest intervals that cover the same: numbered from 1 on over all keys, by key and start. Without a key all rows are of key 0."""
    rows = _real(df, key, start, end)
    points = rows.select(F.col("key"), F.col("s").alias("at"), F.lit(1).alias("open")).unionByName(rows.select(F.col("key"), F.col("e").alias("at"), F.lit(-1).alias("open")))
    points = points.groupBy("key", "at").agg(F.sum("open").alias("open")).where("open <> 0")
    deep = running_sums(points, ["key", "at"], ["open"])
    edge = deep.withColumns({"begins": (F.col("open_to") == F.col("open")).cast("long"), "ends": (F.col("open_to") == 0).cast("long")}).where("begins = 1 OR ends = 1")
    told = running_sums(edge.select("key", "at", "begins", "ends"), ["key", "at"], ["begins", "ends"])
    starts = told.where("begins = 1").select("key", F.col("begins_to").alias("number"), F.col("at").alias("start"))
    ends = told.where("ends = 1").select(F.col("ends_to").alias("number"), F.col("at").alias("end"))
    return written(starts.join(ends, "number").select("key", "number", "start", "end"), "union")


def _met(segments: DataFrame, union: DataFrame) -> DataFrame:
    """segments (id, key, s, e) with `first` and `last`, the numbers of the union's intervals that they meet; last < first where they meet none."""
    marks = union.select("key", F.col("start").alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("ends")).unionByName(union.select("key", F.col("end").alias("at"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))
    asked = segments.select("key", F.col("s").alias("at")).unionByName(segments.select("key", F.col("e").alias("at"))).distinct().withColumns({"starts": F.lit(0), "ends": F.lit(0)})
    points = marks.unionByName(asked).groupBy("key", "at").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    told = written(running_sums(points, ["key", "at"], ["starts", "ends"]), "met")
    at_s = told.select("key", F.col("at").alias("s"), (F.col("ends_to") + 1).alias("first"))
    at_e = told.select("key", F.col("at").alias("e"), (F.col("starts_to") - F.col("starts")).alias("last"))
    return segments.join(at_s, ["key", "s"]).join(at_e, ["key", "e"])


def covered(segments: DataFrame, cover: DataFrame, ident: str, key: str | None, start: str, end: str) -> DataFrame:
    """(id, key, start, end): the parts of each segment that the cover's rows, together, cover. Segments and cover have the same names for key, start and end; ids tell segments apart."""
    return _pieces(segments, cover, ident, key, start, end, True)


def uncovered(segments: DataFrame, cover: DataFrame, ident: str, key: str | None, start: str, end: str) -> DataFrame:
    """(id, key, start, end): the parts of each segment that no row of the cover covers."""
    return _pieces(segments, cover, ident, key, start, end, False)


def _pieces(segments: DataFrame, cover: DataFrame, ident: str, key: str | None, start: str, end: str, inside: bool) -> DataFrame:
    union = union_of(cover, key, start, end)
    k = F.col(key) if key else F.lit(0)
    rows = written(segments.select(F.col(ident).alias("id"), k.alias("key"), F.col(start).alias("s"), F.col(end).alias("e")).where("key IS NOT NULL AND s < e"), "segments")
    met = _met(rows, union)
    if inside:
        each = met.where("last >= first").withColumn("number", F.explode(F.sequence("first", "last")))
        both = each.join(union.select("number", "start", "end"), "number")
        return both.select("id", "key", F.greatest("s", "start").alias("start"), F.least("e", "end").alias("end"))
    # a gap lies behind interval number - 1 and before interval number; the segment's own ends close the first and the last
    each = met.withColumn("number", F.explode(F.sequence("first", F.greatest("first", F.col("last") + 1))))
    behind = union.select((F.col("number") + 1).alias("number"), F.col("end").alias("from"))
    before = union.select("number", F.col("start").alias("to"))
    both = each.join(behind, "number", "left").join(before, "number", "left")
    lo = F.when(F.col("number") == F.col("first"), F.col("s")).otherwise(F.col("from"))
    hi = F.when(F.col("number") > F.col("last"), F.col("e")).otherwise(F.col("to"))
    return both.select("id", "key", lo.alias("start"), hi.alias("end")).where("start < end")


def supported(segments: DataFrame, cover: DataFrame, floors: DataFrame, ident: str, key: str | None, start: str, end: str) -> DataFrame:
    """(id, key, start, end): the parts of each segment that the cover covers and that a floor lies under."""
    k = key or "key"
    free = covered(segments, cover, ident, key, start, end).withColumnsRenamed({"key": k, "start": start, "end": end})
    numbered = written(free.withColumn("piece", F.monotonically_increasing_id()), "free")
    parts = covered(numbered, floors, "piece", key, start, end).select(F.col("id").alias("piece"), "key", "start", "end")
    return parts.join(numbered.select("piece", "id"), "piece").select("id", "key", "start", "end")


def pair_count(left: DataFrame, right: DataFrame, start: str, end: str, key: str | None = None, closed: bool = False) -> DataFrame:
    """One row, `pairs`: how many pairs of a left and a right interval of a key meet, in a decimal. With closed, intervals that touch meet too, and those of one point count.

    A pair meets unless one ends before the other starts: from all right intervals that start before a left one ends, those that end
    before it starts are taken off; both are running sums over the end points.
    """

    def rows(df: DataFrame) -> DataFrame:
        k = F.col(key) if key else F.lit(0)
        own = df.select(k.alias("key"), F.col(start).alias("s"), F.col(end).alias("e"))
        return own.where("key IS NOT NULL AND s <= e" if closed else "key IS NOT NULL AND s < e")

    def points(df: DataFrame, side: str) -> DataFrame:
        names = ["l_s", "l_e", "r_s", "r_e"]
        put = lambda at, own: df.select("key", F.col(at).alias("at"), *[F.lit(int(n == own)).alias(n) for n in names])
        return put("s", f"{side}_s").unionByName(put("e", f"{side}_e"))

    both = points(rows(left), "l").unionByName(points(rows(right), "r")).groupBy("key", "at").agg(*[F.sum(n).alias(n) for n in ("l_s", "l_e", "r_s", "r_e")])
    told = running_sums(both, ["key", "at"], ["r_s", "r_e"])
    started = F.col("r_s_to") if closed else F.col("r_s_to") - F.col("r_s")
    ended = F.col("r_e_to") - F.col("r_e") if closed else F.col("r_e_to")
    big = lambda c: c.cast("decimal(19,0)")
    return told.agg(F.coalesce(F.sum(big(F.col("l_e")) * big(started) - big(F.col("l_s")) * big(ended)), F.lit(0)).cast("decimal(38,0)").alias("pairs"))
