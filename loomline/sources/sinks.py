"""Sinks: projected CSV, key-value dumps, appended lines, JSON lines stamped with a run, graphs as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def key_value_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    r"""A column `value` of lines \key\value; empty values are deletions and go."""
    return df.where(F.col(value) != "").select(F.concat(F.lit("\\"), F.col(key), F.lit("\\"), F.col(value)).alias("value"))


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Parquet in folders by a hash of the key, so that a lookup reads one folder."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def append_lines(df: DataFrame, path: str, columns: list[str], separator: str = ":") -> None:
    df.select(F.concat(F.lit(separator), F.concat_ws(separator, *columns)).alias("value")).write.mode("append").text(path)


def append_json(df: DataFrame, path: str, run: str) -> None:
    df.withColumn("run", F.lit(run)).write.mode("append").json(path)


def matrix_market_lines(edges: DataFrame) -> DataFrame:
    """The text of a square sparse matrix, in order: a header, its sizes, which are those of the greatest node, then "row column value" from 1 on. Columns: at, value."""
    size = F.coalesce(F.greatest(F.max("src"), F.max("dst")).cast("long") + 1, F.lit(0))
    n = edges.agg(F.concat_ws(" ", size, size, F.count("*")).alias("value")).select(F.array(*map(F.lit, (1, 0, 0))).cast("array<long>").alias("at"), "value")
    head = edges.sparkSession.range(1).select(F.array(*map(F.lit, (0, 0, 0))).cast("array<long>").alias("at"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value"))
    body = edges.select(F.array(F.lit(2).cast("long"), F.col("src").cast("long"), F.col("dst").cast("long")).alias("at"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "weight").alias("value"))
    return head.unionByName(n).unionByName(body).orderBy("at")


def dot_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("  n%d -> n%d;", F.col("src").cast("long"), F.col("dst").cast("long")).alias("value"))
