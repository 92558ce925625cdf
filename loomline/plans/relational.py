"""Queries over the star schema: filters, sorts, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators import aggregates, filters, joins, windows
from loomline.plans.registry import query
from loomline.session import table as t


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""SELECT s_suppkey, s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal >= 0 AND lower(s_name) LIKE '%supplier%' AND (n_nationkey < 12 OR starts_with(lower(n_name), 'n'))""")
def mask_filter_sort(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    seen = filters.visible(rows, [[("s_acctbal", ">=", 0.0), ("s_name", "contains", "SUPPLIER")]], [[("n_nationkey", "<", 12)], [("n_name", "starts", "N")]])
    return seen.select("s_suppkey", "s_name", "n_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("""SELECT p_partkey, p_name FROM part WHERE lower(p_name) NOT LIKE '%a%' OR p_name <= 'b' OR p_size <> 7""")
def mask_text_operators(spark: SparkSession, sf: str) -> DataFrame:
    return filters.visible(t(spark, sf, "part"), [], [[("p_name", "lacks", "A")], [("p_name", "<=", "B")], [("p_size", "!=", 7)]]).select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_size FROM part WHERE (p_size & 3) <> 0 AND (p_size & 4) = 4 AND (p_size & 8) = 0""")
def flag_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_flags(t(spark, sf, "part"), "p_size", any_of=3, all_of=4, none_of=8).select("p_partkey", "p_size")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 10 ORDER BY 1 LIMIT 1""")
def next_match(spark: SparkSession, sf: str) -> DataFrame:
    return filters.next_match(t(spark, sf, "customer"), "c_custkey", 10, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey = 7""")
def match_chain(spark: SparkSession, sf: str) -> DataFrame:
    return filters.chain(t(spark, sf, "customer"), "c_custkey", F.col("c_nationkey") == 7).select("c_custkey")


@query("""SELECT p_partkey FROM part WHERE (p_size - 25.0) * (p_size - 25.0) + (p_retailprice - 950.0) * (p_retailprice - 950.0) <= 900.0""")
def radius_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.within_radius(t(spark, sf, "part"), ["p_size", "p_retailprice"], [25.0, 950.0], 30.0).select("p_partkey")


@query("""SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%M_D%UM%' AND p_name LIKE '%e_ b%'""")
def wildcard_match(spark: SparkSession, sf: str) -> DataFrame:
    from loomline.functions.strings import wildcard

    return t(spark, sf, "part").where(wildcard("p_type", "*M?D*UM*") & wildcard("p_name", "*e? b*")).select("p_partkey", "p_type")


@query("""WITH near AS (SELECT n_nationkey, n_name, (lower(n_name) = 'nation_13')::INT AS exact FROM nation WHERE starts_with(lower(n_name), 'nation_13')),
top AS (SELECT max(exact) AS best, count(*) AS n FROM near)
SELECT n_nationkey, n_name FROM near, top WHERE exact = best AND (best = 1 OR n = 1)""")
def prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return filters.lookup_by_prefix(t(spark, sf, "nation"), "n_name", "Nation_13").select("n_nationkey", "n_name")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS deviation,
round(sum(value), 2) AS total FROM events WHERE isfinite(value) GROUP BY event_type""")
def finite_moments(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy("event_type").agg(*aggregates.moments("value"), F.round(aggregates.finite_sum("value"), 2).alias("total"))


@query("""SELECT round(sum(p_retailprice), 2) AS p_retailprice_sum, count(p_retailprice) AS p_retailprice_n, round(sum(s), 2) AS s_sum, count(s) AS s_n,
round(sum(p_retailprice) FILTER (s IS NOT NULL), 2) AS p_retailprice_complete, round(sum(s) FILTER (p_retailprice IS NOT NULL), 2) AS s_complete,
count(*) FILTER (s IS NOT NULL AND p_retailprice IS NOT NULL) AS complete_n
FROM (SELECT p_retailprice, CASE WHEN p_size > 10 THEN p_size::DOUBLE END AS s FROM part)""")
def complete_case_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "part").select("p_retailprice", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("s"))
    return rows.agg(*aggregates.complete_cases(["p_retailprice", "s"]))


@query("""SELECT p_brand, round(pow(sum(p_size * pow(p_retailprice, 2.0)) / sum(p_size), 0.5), 4) AS square_mean,
round(exp(sum(p_size * ln(p_retailprice)) / sum(p_size)), 4) AS geometric_mean FROM part GROUP BY p_brand""")
def power_means(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").groupBy("p_brand").agg(F.round(aggregates.power_mean("p_retailprice", "p_size", 2.0), 4).alias("square_mean"), F.round(aggregates.power_mean("p_retailprice", "p_size", 0), 4).alias("geometric_mean"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
r AS (SELECT o_custkey, row_number() OVER (PARTITION BY month ORDER BY total DESC, o_custkey) AS place FROM m)
SELECT o_custkey, count(*) AS places, count(*) FILTER (place = 1) AS firsts, sum(100 // place)::BIGINT AS points FROM r WHERE place <= 99
GROUP BY o_custkey ORDER BY points DESC, o_custkey LIMIT 50""")
def points_ladder(spark: SparkSession, sf: str) -> DataFrame:
    by = t(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), "o_custkey").agg(F.sum("o_totalprice").alias("total"))
    ranks = by.withColumn("place", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("total"), "o_custkey"))).where("place <= 99")
    return aggregates.ladder(ranks, "o_custkey", "place", 100, 50)


@query("""SELECT n_nationkey, count(c_custkey) AS votes FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1""")
def option_votes(spark: SparkSession, sf: str) -> DataFrame:
    ballots = t(spark, sf, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("choice"))
    return aggregates.votes(ballots, "choice", t(spark, sf, "nation").select("n_nationkey"), "n_nationkey")


@query("""WITH v AS (SELECT c_mktsegment, count(*) AS votes FROM customer GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY votes DESC, c_mktsegment) AS place, sum(votes) OVER () AS voters FROM v)
SELECT c_mktsegment, votes, place, place = 1 AND voters - votes < votes AS certain FROM o WHERE place <= 2""")
def vote_decision(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.decided(t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("votes")), "c_mktsegment")


@query("""WITH w AS (SELECT n_regionkey, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
u AS (SELECT *, floor(1000 * sum(weight) OVER (ORDER BY n_regionkey) / sum(weight) OVER ())::BIGINT AS upto FROM w)
SELECT n_regionkey, weight, upto - lag(upto, 1, 0) OVER (ORDER BY n_regionkey) AS share FROM u""")
def apportion_by_weight(spark: SparkSession, sf: str) -> DataFrame:
    w = t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("weight"))
    return aggregates.apportion(w, 1000, "weight", "n_regionkey")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views,
round(sum(value) FILTER (event_type = 'purchase'), 2) AS spent FROM events GROUP BY user_id""")
def event_pivot(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return t(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "view").alias("views"), F.round(F.sum(F.when(kind == "purchase", F.col("value"))), 2).alias("spent"))


@query("""SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000) DESC) AS place FROM orders""")
def rank_competition(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("price"))
    return windows.ranks(rows, ["o_orderstatus"], [F.col("price")], falling=True).select("o_orderkey", "place")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000) DESC, o_orderkey) AS place FROM orders""")
def rank_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("price"))
    return windows.strict_ranks(rows, ["o_orderstatus"], [F.desc("price"), F.asc("o_orderkey")]).select("o_orderkey", "place")


@query("""WITH b AS (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey) AS place FROM b) SELECT * FROM r WHERE place <= 5""")
def best_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return windows.best_per_key(t(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice", 5).withColumn("place", F.col("place").cast("long"))


@query("""SELECT event_id, round(CASE WHEN dt > 0 THEN greatest(0.0, dv) * 1e6 / dt END, 6) AS rate FROM (SELECT event_id,
epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", F.round(windows.counter_rate("value", "ts", ["user_id"], "event_id"), 6).alias("rate"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) / 86400, 6) AS rate FROM events""")
def trailing_rate(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", F.round(windows.trailing_sum(F.col("value"), "ts", ["user_id"], 86400) / 86400, 6).alias("rate"))


@query("""SELECT event_id, round(avg(value) OVER w, 9) AS mean, round(var_pop(value) OVER w, 2) AS variance FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def rolling_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.rolling_over(t(spark, sf, "events").select("event_id", "event_type", "ts", "value"), "value", ["event_type"], ["ts", "event_id"], 60)
    return rows.select("event_id", F.round("mean", 9).alias("mean"), F.round("variance", 2).alias("variance"))


@query("""WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e FROM events),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
m AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, island::BIGINT AS island, min(s) AS start, max(e) AS "end", count(*) AS n FROM m GROUP BY ALL""")
def session_islands(spark: SparkSession, sf: str) -> DataFrame:
    at = windows.micros("ts")
    return windows.islands(t(spark, sf, "events"), "user_id", at, at + 3_600_000_000)


@query("""WITH top AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS choice FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)),
s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS slot FROM top WHERE choice <= 2)
SELECT l_partkey, l_suppkey, choice, slot FROM s WHERE slot < 8""")
def capacity_routing(spark: SparkSession, sf: str) -> DataFrame:
    scores = t(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    out = windows.route(scores, "l_partkey", "l_suppkey", "q", 2, 8)
    return out.select("l_partkey", "l_suppkey", F.col("choice").cast("long").alias("choice"), F.col("slot").cast("long").alias("slot"))


@query("""SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY ALL""")
def step_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return windows.steps_of(rows, "user_id", "at", "event_type").groupBy(F.col("from").alias("a"), F.col("to").alias("b")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS x, l_partkey % 100 AS y FROM lineitem WHERE l_suppkey <> l_partkey % 100)
SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM e WHERE EXISTS (SELECT 1 FROM e AS f WHERE f.x = e.y AND f.y = e.x)""")
def mutual_self_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("own"), (F.col("l_partkey") % 100).alias("peer"))
    return joins.mutual_pairs(rows, "own", "peer")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS ordered FROM customer""")
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders").where("o_orderstatus = 'F'")
    on = c["c_custkey"] == o["o_custkey"]
    return c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("ordered")).unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit(False).alias("ordered")))


@query("""SELECT o_orderkey, event_id FROM (SELECT o_orderkey, epoch_us(o_orderdate) // 86400000000 AS a, o_custkey % 150 AS k FROM orders) AS o
JOIN (SELECT event_id, epoch_us(ts) // 86400000000 - 9500 AS b, user_id % 150 AS k FROM events) AS e ON o.k = e.k AND o.a < e.b + 3 AND e.b < o.a + 10""")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    day = 86_400_000_000
    o = t(spark, sf, "orders").select("o_orderkey", F.floor(windows.micros("o_orderdate") / day).alias("a"), (F.col("o_custkey") % 150).alias("k")).withColumn("a2", F.col("a") + 10)
    e = t(spark, sf, "events").select("event_id", (F.floor(windows.micros("ts") / day) - 9500).alias("b"), (F.col("user_id") % 150).alias("k")).withColumn("b2", F.col("b") + 3)
    return joins.interval_join(o, e, "a", "a2", "b", "b2", 16, ["k"]).select("o_orderkey", "event_id")


@query("""SELECT o_custkey, bool_or(hit) AS overlaps FROM (SELECT o_custkey, coalesce(max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s, false) AS hit
FROM (SELECT o_custkey, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 86400000000 * 20 AS e FROM orders)) GROUP BY 1""")
def interval_overlap_exists(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").select("o_custkey", windows.micros("o_orderdate").alias("s")).withColumn("e", F.col("s") + 86_400_000_000 * 20)
    return joins.overlapping(rows, "o_custkey", "s", "e")


_BOXES = "SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 20 AS y, (p_partkey % 50)::DOUBLE AS z FROM part"


@query(f"""WITH b AS ({_BOXES}) SELECT p.id AS a, q.id AS b FROM b AS p JOIN b AS q ON p.id < q.id
AND p.x + 2.25 >= q.x AND p.x - 0.25 <= q.x + 2 AND p.y + 2.25 >= q.y AND p.y - 0.25 <= q.y + 2 AND p.z + 2.25 >= q.z AND p.z - 0.25 <= q.z + 2""")
def box_join(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 20, (F.col("p_partkey") % 50).cast("double")).alias("lo"))
    boxes = p.withColumn("hi", F.transform("lo", lambda x: x + 2))
    return joins.box_pairs(boxes, cell=8.0, gap=0.25)


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query, vec_id AS id, round(list_dot_product(qv, qv) + list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 2 * list_dot_product(qv, embedding::DOUBLE[]), 6) AS dist2 FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist2, id) AS place FROM d) SELECT query, id, place, round(dist2, 3) AS dist2 FROM r WHERE place <= 5""")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = joins.nearest(v.where("id % 100 = 0"), v, 5)
    return out.select("query", "id", F.col("place").cast("long").alias("place"), F.round("dist2", 3).alias("dist2"))


@query("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS view,
arg_max(value, (ts, event_id)) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id""")
def latest_values(spark: SparkSession, sf: str) -> DataFrame:
    return joins.latest_values(t(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], "value", ["click", "view", "error"])


@query("""SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey""")
def roster_join(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return joins.with_roster(t(spark, sf, "customer").select("c_custkey"), n, "c_custkey", "n", F.lit(0))


@query("""SELECT l_suppkey AS s, n, first, last FROM (SELECT l_suppkey, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1)""")
def lifetimes(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@query("""SELECT DISTINCT ON (l_returnflag, l_linestatus, l_suppkey) l_returnflag, l_linestatus, l_suppkey, l_orderkey, l_partkey FROM lineitem
ORDER BY l_returnflag, l_linestatus, l_suppkey, l_orderkey, l_linenumber, l_partkey""")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus", "l_suppkey"]
    first = F.min_by(F.struct("l_orderkey", "l_partkey"), F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("r")
    return t(spark, sf, "lineitem").groupBy(*keys).agg(first).select(*keys, "r.l_orderkey", "r.l_partkey")
