"""Queries of best choices, folds and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators import blocks, folds, matrices, optimal, windows
from loomline.plans.registry import query
from loomline.plans.trees import _TYPES
from loomline.session import table as t


@query()
def state_arborescence(spark: SparkSession, sf: str) -> DataFrame:
    """From the clicks of least value to every state of events that can follow, by the shortest times in which one user's event followed another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    state = (F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")) * 1000 + F.floor(F.col("value") / 4)).cast("long")
    rows = t(spark, sf, "events").withColumns({"src": state, "us": windows.micros("ts")})
    steps = rows.select("src", F.lead("src").over(w).alias("dst"), ((F.lead("us").over(w) - F.col("us")) / 1e6).alias("weight")).where("dst IS NOT NULL")
    return optimal.arborescence(steps.groupBy("src", "dst").agg(F.min("weight").alias("weight")), 1000)


@query()
def order_part_matching(spark: SparkSession, sf: str) -> DataFrame:
    """As many orders as can be given a part of their own among those that they hold."""
    return optimal.matching(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("""WITH e AS (SELECT user_id, event_id, ts, hour(ts)::DOUBLE AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT a.user_id, a.event_id, a.ts, 0.98 ** a.n / 1000 AS p, sum(0.98 ** (a.n - b.n) * b.x * b.x) AS xx, sum(0.98 ** (a.n - b.n) * b.x) AS x, sum(0.98 ** (a.n - b.n)) AS one, sum(0.98 ** (a.n - b.n) * b.x * b.y) AS xy, sum(0.98 ** (a.n - b.n) * b.y) AS y
FROM e AS a JOIN e AS b ON a.user_id = b.user_id AND b.n <= a.n GROUP BY ALL)
SELECT user_id, event_id, round((xy * (one + p) - x * y) / ((xx + p) * (one + p) - x * x), 6) AS slope, round(((xx + p) * y - x * xy) / ((xx + p) * (one + p) - x * x), 6) AS base FROM s""")
def hourly_trend(spark: SparkSession, sf: str) -> DataFrame:
    """How the value of a user's events goes with the hour, as it stands after each of them, older ones counting less."""
    rows = t(spark, sf, "events").select("user_id", "event_id", "ts", F.hour("ts").alias("hour"), "value")
    out = folds.recursive_least_squares(rows, "user_id", ["ts", "event_id"], ["hour"], "value", 0.98)
    return out.select(F.col("key").alias("user_id"), "event_id", F.round(F.col("theta")[0], 6).alias("slope"), F.round(F.col("theta")[1], 6).alias("base"))


@query()
def shuffled_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in a random order that any layout of the table gives."""
    return windows.shuffled(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", (1, 2, 3, 4))


@query("""WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS j FROM embeddings) SELECT a.j AS i, b.j, round(sum(a.v * b.v), 4) AS value FROM e AS a JOIN e AS b USING (vec_id) GROUP BY ALL""")
def gram_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings as one matrix of blocks, times itself the other way round."""
    x = matrices.entries(t(spark, sf, "embeddings"), "vec_id", "embedding")
    tall, flat = blocks.to_blocks(x), blocks.to_blocks(matrices.transpose(x))
    return blocks.to_entries(blocks.product(flat, tall)).select("i", "j", F.round("value", 4).alias("value"))


@query()
def orthonormal_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding in axes in which the columns of all of them are orthonormal."""
    return blocks.orthonormal(t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("axes")), "axes")
