"""Sinks and sources over scratch files in the shared folder, written from whole tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.graphs import _EDGES, supply_edges
from loomline.plans.registry import query
from loomline.session import scratch
from loomline.session import table as t
from loomline.sources import sinks, text


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders""")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Three of the columns of orders, through a CSV sink."""
    path = scratch(spark, "csv")
    sinks.write_csv(t(spark, sf, "orders"), path, ["o_orderkey", "o_totalprice", "o_orderpriority"])
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderpriority string").csv(path, header=True)


@query("""SELECT c_custkey, c_name FROM customer""")
def bucket_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers through folders by a hash of their key; a row comes from its own key's folder alone."""
    path = scratch(spark, "buckets")
    sinks.write_buckets(t(spark, sf, "customer"), path, "c_custkey", 8)
    return spark.read.parquet(path).where(F.col("bucket") == F.pmod(F.xxhash64("c_custkey"), F.lit(8))).select("c_custkey", "c_name")


@query("""SELECT s_suppkey AS key, s_name AS name, 'first' AS run FROM supplier UNION ALL SELECT c_custkey, c_name, 'second' FROM customer""")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines of two runs in one folder, each stamped with its run."""
    path = scratch(spark, "json")
    for run, name, key, label in (("first", "supplier", "s_suppkey", "s_name"), ("second", "customer", "c_custkey", "c_name")):
        sinks.append_json(t(spark, sf, name).select(F.col(key).alias("key"), F.col(label).alias("name")), path, run)
    return spark.read.schema("key long, name string, run string").json(path)


@query("""SELECT ':' || n_nationkey || ':' || n_name AS value FROM nation UNION ALL SELECT ':' || c_custkey || ':' || c_mktsegment FROM customer""")
def appended_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines of two tables, appended to one log."""
    path = scratch(spark, "log")
    sinks.append_lines(t(spark, sf, "nation"), path, ["n_nationkey", "n_name"])
    sinks.append_lines(t(spark, sf, "customer"), path, ["c_custkey", "c_mktsegment"])
    return spark.read.text(path)


@query(f"""WITH e AS ({_EDGES}) SELECT '%%MatrixMarket matrix coordinate real general' AS value UNION ALL SELECT (greatest(max(src), max(dst)) + 1) || ' ' || (greatest(max(src), max(dst)) + 1) || ' ' || count(*) FROM e UNION ALL SELECT (src + 1) || ' ' || (dst + 1) || ' ' || weight FROM e""")
def matrix_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of parts as the text of a sparse matrix."""
    return sinks.matrix_market_lines(supply_edges(spark, sf)).select("value")


@query(f"""SELECT '  n' || src || ' -> n' || dst || ';' AS value FROM ({_EDGES})""")
def dot_text(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of parts as lines of a drawing."""
    return sinks.dot_lines(supply_edges(spark, sf))


@query("""SELECT o_orderkey::DOUBLE AS key, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 0""")
def journal_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders through a journal of tab-separated numbers in which a tenth of the lines is torn."""
    path = scratch(spark, "journal")
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("12.x")).otherwise(F.col("o_totalprice").cast("string"))
    t(spark, sf, "orders").select(F.concat_ws("\t", "o_orderkey", price).alias("value")).write.text(path)
    return text.journal(spark, path, ["key", "price"])


@query("""SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment FROM customer""")
def line_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as records of three lines."""
    path = scratch(spark, "records")
    t(spark, sf, "customer").select(F.concat_ws("\n", "c_custkey", "c_name", "c_mktsegment").alias("value")).write.text(path)
    fields = F.col("fields")
    return text.records_of(text.numbered_lines(spark, path), 3).select(fields[0].alias("key"), fields[1].alias("name"), fields[2].alias("segment"))


@query("""SELECT c_custkey::VARCHAR AS carried, c_mktsegment AS value, c_name AS data FROM customer""")
def tagged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tagged lines, a detail line below the line of its owner, and lines of one token that go."""
    path = scratch(spark, "tagged")
    lines = F.concat(F.lit("owner "), "c_custkey", F.lit("\nalone\nevent "), "c_mktsegment", F.lit(" "), "c_name")
    t(spark, sf, "customer").select(lines.alias("value")).write.text(path)
    return text.tagged_lines(text.numbered_lines(spark, path), "owner").where("key = 'event'").select("carried", "value", "data")


@query("""SELECT least(s_suppkey, s_nationkey)::DOUBLE AS a, greatest(s_suppkey, s_nationkey)::DOUBLE AS b, abs(s_suppkey - s_nationkey)::DOUBLE AS length FROM supplier WHERE s_suppkey <> s_nationkey AND s_suppkey % 5 <> 0 GROUP BY ALL""")
def edge_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected edges read from lines of two points, quoted; one line in five is malformed."""
    far = F.when(F.col("s_suppkey") % 5 == 0, F.lit("nan")).otherwise(F.col("s_nationkey").cast("string"))
    rows = t(spark, sf, "supplier").select(F.concat(F.lit("'"), F.col("s_suppkey").cast("string"), F.lit(" 0 0'*'"), far, F.lit(" 0 0'")).alias("text"))
    return text.edge_list(rows).select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b"), "length")


@query("""SELECT count(DISTINCT c_mktsegment) AS files FROM customer""")
def listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a folder of folders, found by pattern: one for each segment of customers."""
    path = scratch(spark, "listing")
    t(spark, sf, "customer").select("c_custkey", "c_mktsegment").repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    return text.listing(spark, path, "*.parquet").agg(F.count("*").alias("files"))
