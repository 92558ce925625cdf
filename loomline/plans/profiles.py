"""Profiles, snapshots, rankings, and joins of ranges, rings and sets, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import more
from loomline.operators import graphs, windows
from loomline.plans.graphs import _EDGES, supply_edges
from loomline.plans.registry import query
from loomline.session import table as t


@query("""SELECT event_type, count(value) AS n, min(value) AS low, quantile_cont(value, 0.5) AS mid, round(quantile_cont(value, 0.9), 9) AS p90, max(value) AS high FROM events WHERE isfinite(value) GROUP BY event_type""")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind of event: finite values, and their least, median, ninth decile and greatest."""
    rows = t(spark, sf, "events").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    ends = rows.groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    marks = windows.percentiles(rows, "event_type", "value", [0.5, 0.9]).select(F.col("key").alias("event_type"), F.col("p0").alias("mid"), F.round("p1", 9).alias("p90"))
    return ends.join(marks, "event_type")


@query("""SELECT event_type, count(*) AS users, round(sum(value), 4) AS total, max(epoch_us(ts)) AS newest, count(*) FILTER (value < 10) AS late FROM (SELECT DISTINCT ON (user_id) * FROM events ORDER BY user_id, ts DESC, event_id DESC) GROUP BY event_type""")
def fleet_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each user, summed by kind: users, values, the newest time and how many are under a mark."""
    last = F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id")).alias("e")
    rows = t(spark, sf, "events").groupBy("user_id").agg(last).select("e.*")
    return rows.groupBy("event_type").agg(F.count("*").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("newest"), F.count_if(F.col("value") < 10).alias("late"))


@query("""SELECT l_returnflag || l_linestatus AS key, count(*) AS n, sum(count(*)) OVER (ORDER BY l_returnflag || l_linestatus) - count(*) AS start FROM lineitem GROUP BY 1""")
def group_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of lines with where each starts when they are laid end to end; the window sees a row per group."""
    rows = t(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("key")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("key", "n", F.coalesce(before, F.lit(0)).alias("start"))


@query("""SELECT a.s AS a, b.s AS b, count(*) AS both, round(count(*) / least(any_value(a.n), any_value(b.n)), 6) AS overlap FROM (SELECT l_suppkey AS s, l_partkey AS p, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS a
JOIN (SELECT l_suppkey AS s, l_partkey AS p, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS b ON a.p = b.p AND a.s < b.s GROUP BY a.s, b.s HAVING count(*) >= 2""")
def set_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that share two parts or more, with the share of the smaller one's parts; pairs come from a join on the part."""
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"))
    both = rows.withColumnRenamed("s", "a").join(rows.withColumnRenamed("s", "b"), "p").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both")).where("both >= 2")
    named = both.join(sizes.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b")
    return named.select("a", "b", "both", F.round(F.col("both") / F.least("na", "nb"), 6).alias("overlap"))


@query("""SELECT event_id, hour(ts) * 60 + minute(ts) AS at, (1320 <= a OR a < 360) AS night FROM (SELECT *, hour(ts) * 60 + minute(ts) AS a FROM events)""")
def ring_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an event's minute lies in the night, from 22:00 round to 6:00."""
    at = F.hour("ts") * 60 + F.minute("ts")
    return t(spark, sf, "events").select("event_id", at.cast("long").alias("at"), more.circular_overlap(F.lit(1320), F.lit(360), at, at + 1, 1440).alias("night"))


@query("""SELECT p_partkey, coalesce((SELECT min(b) FROM range(0, 50, 10) AS r(b) WHERE p_size > b AND p_size <= b + 5), CASE WHEN p_size % 10 = 0 AND p_size > 0 THEN least(p_size - 10, 40) ELSE least((p_size - 1) // 10 * 10, 40) END)::BIGINT AS box FROM part""")
def nearest_box(spark: SparkSession, sf: str) -> DataFrame:
    """The box (b, b + 5] of each ten that holds a part's size, else the one before it, whose centre is nearest among those begun."""
    size = F.col("p_size").cast("long")
    inside = F.when((F.pmod(size, F.lit(10)) >= 1) & (F.pmod(size, F.lit(10)) <= 5) & (size < 50), F.floor(size / 10) * 10)
    return t(spark, sf, "part").select("p_partkey", F.coalesce(inside, F.least(F.floor((size - 1) / 10) * 10, F.lit(40))).cast("long").alias("box"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place, o_totalprice < min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS record FROM orders""")
def personal_records(spark: SparkSession, sf: str) -> DataFrame:
    """An order's place among its customer's, and whether it was less than all before it."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    before = F.min("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", place.cast("long").alias("place"), (F.col("o_totalprice") < before).alias("record"))


@query("""SELECT label, i AS dim, round(max(v), 6) AS high, round(avg(v), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS j, (generate_subscripts(embedding, 1) - 1) // 4 AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY label, i""")
def pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors pooled by fours, greatest and mean, by label."""
    rows = t(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("j", "v"))
    return rows.groupBy("label", F.floor(F.col("j") / 4).alias("dim")).agg(F.round(F.max(F.col("v").cast("double")), 6).alias("high"), F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("""SELECT vec_id, i - 1 AS place, round(v[i] * 0.25 + v[i + 1] * 0.5 + v[i + 2] * 0.25, 6) AS smooth FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 63)) AS i FROM embeddings)""")
def convolved(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector smoothed by a kernel of three."""
    at = lambda k: F.get("embedding", F.col("place") + k).cast("double")
    rows = t(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(61))).alias("place"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.round(at(0) * 0.25 + at(1) * 0.5 + at(2) * 0.25, 6).alias("smooth"))


@query("""SELECT event_id, round(embedding[1]::DOUBLE, 6) AS looked_up FROM events JOIN embeddings ON vec_id = user_id""")
def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with its user's row of the table of vectors."""
    rows = t(spark, sf, "embeddings").select(F.col("vec_id").alias("user_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("looked_up"))
    return t(spark, sf, "events").join(rows, "user_id").select("event_id", "looked_up")


@query("""SELECT user_id, beat, count(*) AS seen, min(event_id) AS first FROM (SELECT *, epoch_us(ts) // 3600000000 AS beat FROM events) GROUP BY ALL""")
def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """At most one beat an hour and user, with what it stands for."""
    beat = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return t(spark, sf, "events").groupBy("user_id", beat.alias("beat")).agg(F.count("*").alias("seen"), F.min("event_id").alias("first"))


@query("""SELECT user_id, map_from_entries(list((event_type, value) ORDER BY event_type)) AS state FROM (SELECT DISTINCT ON (user_id, event_type) * FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC) GROUP BY user_id""".replace("map_from_entries(list((event_type, value) ORDER BY event_type)) AS state", "string_agg(event_type || '=' || round(value)::BIGINT, ',' ORDER BY event_type) AS state"))
def merged_maps(spark: SparkSession, sf: str) -> DataFrame:
    """A user's map of kinds to their latest values, as sorted text."""
    rows = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    pair = F.concat("event_type", F.lit("="), F.round("value").cast("long").cast("string"))
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("state"))


@query("""SELECT n_name, sum(o_totalprice > 0)::BIGINT AS orders, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def grouped_unions(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation its orders, and the union of its customers' segments."""
    c, n = t(spark, sf, "customer"), t(spark, sf, "nation")
    rows = t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count_if(F.col("o_totalprice") > 0).alias("orders"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))


@query(f"""WITH e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, count(DISTINCT e.dst) AS successors, count(DISTINCT f.src) AS predecessors, count(e.dst) = 0 AS sink, count(f.src) = 0 AS source FROM n LEFT JOIN e ON e.src = node LEFT JOIN e AS f ON f.dst = node GROUP BY node""")
def graph_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Which nodes begin or end the graph of parts."""
    d = graphs.degrees(supply_edges(spark, sf))
    return d.select("node", F.col("out_degree").alias("successors"), F.col("in_degree").alias("predecessors"), (F.col("out_degree") == 0).alias("sink"), (F.col("in_degree") == 0).alias("source"))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES}) UNION SELECT p_partkey * 2 + 1, p_partkey FROM part WHERE p_size = 50), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, least(node, coalesce((SELECT min(c.dst) FROM c JOIN c AS d ON d.src = c.dst AND d.dst = c.src WHERE c.src = node), node)) AS component FROM n""")
def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that lead to each other, where the greatest parts are led back to."""
    back = t(spark, sf, "part").where("p_size = 50").select((F.col("p_partkey") * 2 + 1).alias("src"), F.col("p_partkey").alias("dst"))
    return graphs.strong_components(supply_edges(spark, sf).select("src", "dst").unionByName(back).distinct())


@query(f"""WITH RECURSIVE e AS ({_EDGES}), g AS (SELECT p_partkey AS node FROM part WHERE p_size > 25), p(src, dst, weight) AS (SELECT * FROM e WHERE src NOT IN (SELECT node FROM g)
UNION SELECT p.src, e.dst, p.weight + e.weight FROM p JOIN e ON e.src = p.dst WHERE p.dst IN (SELECT node FROM g))
SELECT src, dst, min(weight) AS weight FROM p WHERE dst NOT IN (SELECT node FROM g) AND src <> dst GROUP BY ALL""")
def eliminated(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of parts led past those of over 25 in size."""
    return graphs.without_nodes(supply_edges(spark, sf), t(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("node")))
