"""Graph and matrix queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import graphs, matrices
from loomline.plans.registry import query
from loomline.session import table as t


def supply_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A graph over all lines: a part leads to numbers of about twice its own, by who supplies it, and so never to a lower one; weights are least quantities."""
    rows = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") * 2 + 1 + F.col("l_suppkey") % 3).alias("dst"), F.col("l_quantity").alias("weight"))
    return rows.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


_EDGES = "SELECT l_partkey AS src, l_partkey * 2 + 1 + l_suppkey % 3 AS dst, min(l_quantity) AS weight FROM lineitem GROUP BY ALL"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b(node, level) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, b.level + 1 FROM b JOIN e ON b.node = e.src)
SELECT node, min(level)::BIGINT AS level FROM b GROUP BY node""")
def bfs_levels(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.bfs(supply_edges(spark, sf), spark.range(1, 2).withColumnRenamed("id", "node"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), d(node, dist) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION ALL SELECT node, min(dist) FROM (SELECT e.dst AS node, d.dist + e.weight AS dist FROM d JOIN e ON d.node = e.src) GROUP BY node)
SELECT node, round(min(dist), 2) AS dist FROM d GROUP BY node""")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.shortest_paths(supply_edges(spark, sf), 1).select("node", F.round("dist", 2).alias("dist"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT src, dst FROM c""")
def closure(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.closure(supply_edges(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, 1000 + o_custkey // 3 AS b FROM customer JOIN orders ON c_custkey = o_custkey),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON r.node = s.a)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "customer").join(t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return graphs.components(rows.select(F.col("c_nationkey").cast("long").alias("src"), (1000 + F.floor(F.col("o_custkey") / 3)).alias("dst")))


@query("""SELECT s_nationkey AS from_class, c_nationkey AS to_class, min(l_quantity) AS delay FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL""")
def quotient_min(spark: SparkSession, sf: str) -> DataFrame:
    edges = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst")).agg(F.min("l_quantity").alias("delay"))
    s = t(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("vertex"), F.col("s_nationkey").alias("class"))
    c = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("vertex"), F.col("c_nationkey").alias("class"))
    return graphs.quotient(edges, s.unionByName(c))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
l(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON l.node = e.src) SELECT node, max(level)::BIGINT AS level FROM l GROUP BY node""")
def topological_levels(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.levels(supply_edges(spark, sf))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES})), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT src, dst FROM e WHERE EXISTS (SELECT 1 FROM e AS f JOIN c ON f.dst = c.src WHERE f.src = e.src AND c.dst = e.dst)""")
def redundant_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.redundant_edges(supply_edges(spark, sf))


@query(f"""WITH e AS ({_EDGES}) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node""")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.degrees(supply_edges(spark, sf))


@query("""WITH a AS (SELECT label AS i, j, avg(v) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS j FROM embeddings) GROUP BY ALL)
SELECT x.i, y.i AS j, round(sum(x.v * y.v), 5) AS value FROM a AS x JOIN a AS y ON x.j = y.j GROUP BY ALL""")
def matrix_product(spark: SparkSession, sf: str) -> DataFrame:
    a = matrices.entries(t(spark, sf, "embeddings"), "label", "embedding").groupBy("i", "j").agg(F.avg("value").alias("value"))
    return matrices.matmul(a, matrices.transpose(a)).select("i", "j", F.round("value", 5).alias("value"))


@query("""SELECT vec_id, round(exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w), 9) AS weight FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings) WINDOW w AS (PARTITION BY label)""")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    return matrices.softmax_rows(rows, "x", ["label"]).select("vec_id", F.round("weight", 9).alias("weight"))


@query("""SELECT l_suppkey % 16 AS slot, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1""")
def scatter_add(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).alias("slot"), F.col("l_extendedprice").alias("total"))
    return matrices.scatter_add(rows, "slot", "total").withColumn("total", F.round("total", 2))
