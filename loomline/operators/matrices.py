"""Matrices as relations of (i, j, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import written


def entries(df: DataFrame, row: str, vector: str) -> DataFrame:
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "value")).select("i", "j", F.col("value").cast("double").alias("value"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Partial sums are made before the shuffle by (i, j)."""
    x = a.select("i", F.col("j").alias("k"), F.col("value").alias("x"))
    y = b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def softmax_rows(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """df with `weight`, which sums to 1 over each key. A key's greatest value and its sum are aggregated before they are shuffled, and met in joins that split a hot key."""
    names = {k: f"_{k}" for k in keys}
    same = lambda other: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(other[n]) for k, n in names.items()], F.lit(True))
    top = written(df.groupBy(*keys).agg(F.max(value).alias("_top")).withColumnsRenamed(names), "softmax")
    e = df.join(top, same(top)).drop(*names.values()).withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    total = written(e.groupBy(*keys).agg(F.sum("_e").alias("_total")).withColumnsRenamed(names), "softmax")
    return e.join(total, same(total)).withColumn("weight", F.col("_e") / F.col("_total")).select(*df.columns, "weight")


def scatter_add(df: DataFrame, index: str, value: str) -> DataFrame:
    return df.groupBy(index).agg(F.sum(value).alias(value))
