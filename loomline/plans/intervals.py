"""Queries of interval sets: what lines cover of the time of orders, and how many pairs meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import intervals
from loomline.plans.registry import query
from loomline.session import table as t

_SQL = """seg AS (SELECT o_orderkey AS id, c_nationkey AS key, epoch(o_orderdate)::BIGINT // 3600 AS s, epoch(o_orderdate)::BIGINT // 3600 + floor(o_totalprice / 2000)::BIGINT AS e FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (SELECT s_nationkey AS key, epoch(l_shipdate)::BIGINT // 3600 AS s, epoch(l_shipdate)::BIGINT // 3600 + l_quantity::BIGINT AS e, l_tax, l_discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _islands(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT key, min(s) AS {name}s, max(e) AS {name}e FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, e) AS k FROM
(SELECT *, coalesce(s > max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM ({rows}) WHERE s < e)) GROUP BY key, k)"""


def order_times(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as intervals of hours, as long as their price, by the customer's nation: id, key, s, e."""
    rows = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hour = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 3600)
    return rows.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("key"), hour.alias("s"), (hour + F.floor(F.col("o_totalprice") / 2000)).alias("e"))


def line_times(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as intervals of hours, as long as their quantity, by the supplier's nation: key, s, e, l_tax, l_discount."""
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    hour = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 3600)
    return rows.select(F.col("s_nationkey").alias("key"), hour.alias("s"), (hour + F.col("l_quantity").cast("long")).alias("e"), "l_tax", "l_discount")


@query(f"WITH {_SQL}, {_islands('u', 'SELECT key, s, e FROM lines')} SELECT id, seg.key, greatest(s, us) AS start, least(e, ue) AS \"end\" FROM seg JOIN u ON seg.key = u.key AND us < e AND ue > s WHERE s < e")
def covered_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Of each order's hours those in which some line of its nation is on its way."""
    return intervals.covered(order_times(spark, sf), line_times(spark, sf), "id", "key", "s", "e")


@query(f"""WITH {_SQL}, {_islands('u', 'SELECT key, s, e FROM lines')}, c AS (SELECT id, seg.key, s, e, CASE WHEN us IS NOT NULL THEN greatest(s, us) END AS cs, CASE WHEN us IS NOT NULL THEN least(e, ue) END AS ce FROM seg LEFT JOIN u ON seg.key = u.key AND us < e AND ue > s WHERE s < e),
g AS (SELECT id, key, coalesce(lag(ce) OVER w, s) AS start, coalesce(cs, e) AS "end" FROM c WINDOW w AS (PARTITION BY id ORDER BY cs) UNION ALL SELECT id, key, max(ce), max(e) FROM c WHERE ce IS NOT NULL GROUP BY id, key)
SELECT id, key, start, "end" FROM g WHERE start < "end" """)
def uncovered_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Of each order's hours those in which no line of its nation is on its way."""
    return intervals.uncovered(order_times(spark, sf), line_times(spark, sf), "id", "key", "s", "e")


@query(f"""WITH {_SQL}, {_islands('u', 'SELECT key, s, e FROM lines WHERE l_tax >= 0.04')}, {_islands('f', 'SELECT key, s, e FROM lines WHERE l_discount >= 0.05')}
SELECT id, seg.key, greatest(s, us, fs) AS start, least(e, ue, fe) AS "end" FROM seg JOIN u ON seg.key = u.key AND us < e AND ue > s JOIN f ON seg.key = f.key AND fs < least(e, ue) AND fe > greatest(s, us) WHERE s < e""")
def supported_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Of each order's hours those in which both a taxed line and a discounted line of its nation are on their way."""
    lines = line_times(spark, sf)
    return intervals.supported(order_times(spark, sf), lines.where("l_tax >= 0.04"), lines.where("l_discount >= 0.05"), "id", "key", "s", "e")


@query(f"WITH {_SQL} SELECT count(*)::DECIMAL(38,0) AS pairs FROM seg JOIN lines ON seg.key = lines.key AND seg.s < lines.e AND lines.s < seg.e WHERE seg.s < seg.e AND lines.s < lines.e")
def meeting_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of an order and a line of a nation share an hour, without making them."""
    return intervals.pair_count(order_times(spark, sf), line_times(spark, sf), "s", "e", "key")
