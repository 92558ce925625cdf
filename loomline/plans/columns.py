"""Queries that apply built-in and composed scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import arrays, maths, more, strings
from loomline.plans.registry import query
from loomline.session import table as t


@query("""SELECT p_partkey, ceil(p_retailprice)::BIGINT AS up, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS tn, round(asin(1.0 / p_size), 9) AS asn, round(acos(1.0 / p_size), 9) AS acn,
round(atan(p_size), 9) AS atn, p_partkey * 4 AS left2, p_partkey // 8 AS right3, (p_partkey % 7 + 7) % 7 AS positive, round(p_retailprice, 1) AS tenth FROM part""")
def trigonometry(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("p_size").cast("double"), F.col("p_partkey")
    return t(spark, sf, "part").select("p_partkey", F.ceil("p_retailprice").alias("up"), F.round(F.sin(n), 9).alias("s"), F.round(F.cos(n), 9).alias("c"), F.round(F.tan(n), 6).alias("tn"), F.round(F.asin(1 / n), 9).alias("asn"), F.round(F.acos(1 / n), 9).alias("acn"), F.round(F.atan(n), 9).alias("atn"), more.shifted(-k, F.lit(2)).alias("left2"), more.shifted(k, F.lit(-3)).alias("right3"), F.pmod(k, F.lit(7)).alias("positive"), F.round("p_retailprice", 1).alias("tenth"))


@query("""SELECT vec_id, round(v[1] / n, 6) AS unit, round(v[1] - 2 * v[2], 6) AS rotated, round(v[1] - 2 * (v[1] + v[2]) * 0.5, 5) AS mirrored, list_sort(v[1:3])[2] AS mid, round((1 - 0.25) ** 2 * v[1] + 2 * 0.25 * 0.75 * v[2] + 0.25 ** 2 * v[3], 6) AS curve,
round(v[1] / (1 + exp(-v[1])), 6) AS silu, round(0.5 * v[1] * (1 + (exp(2 * g) - 1) / (exp(2 * g) + 1)), 6) AS gelu, round((v[1] * 360 + 540) % 360 - 180, 4) AS turn, round(list_avg(v), 6) AS mean, round(list_sum(v), 6) AS total, v[64:64] || v[1:1] AS ends
FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n, 0.7978845608028654 * (v[1] + 0.044715 * v[1] ** 3) AS g FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""")
def vector_functions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = t(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    x, y, z = (F.col("v")[k] for k in range(3))
    half = F.array(F.lit(0.5**0.5), F.lit(0.5**0.5))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(maths.unit("v")[0], 6).alias("unit"), F.round(x - 2 * y, 6).alias("rotated"), F.round(maths.reflect(F.slice("v", 1, 2), half)[0], 5).alias("mirrored"), maths.median3(x, y, z).alias("mid"), F.round(0.5625 * x + 0.375 * y + 0.0625 * z, 6).alias("curve"), F.round(maths.silu(x), 6).alias("silu"), F.round(maths.gelu(x), 6).alias("gelu"), F.round(maths.angle_between(x * 360, F.lit(0.0)), 4).alias("turn"), F.round(total / F.size("v"), 6).alias("mean"), F.round(total, 6).alias("total"), F.concat(F.slice("v", 64, 1), F.slice("v", 1, 1)).alias("ends"))


@query("""SELECT p_partkey, chr(65 + (p_partkey % 26)::INT) AS letter, sha256(p_name) AS sha, md5(p_name) AS md5, lower(p_name[:3]) = lower(p_type[:3]) AS alike, printf('%.2f', p_retailprice) AS fixed, printf('%06d|%s', p_partkey, p_brand) AS formed,
replace(replace(p_name || chr(10) || '"q"', '"', '\\"'), chr(10), '\\n') AS escaped, '''' || p_brand || ''' ''' || p_type || '''' AS listed, p_type AS second, p_name || ' end' AS appended, contains(p_name, p_brand) AS inside FROM part""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    listed = more.quoted_list(F.array("p_brand", "p_type"))
    return t(spark, sf, "part").select("p_partkey", F.char(65 + F.col("p_partkey") % 26).alias("letter"), F.sha2(name, 256).alias("sha"), F.md5(name).alias("md5"), strings.same_prefix("p_name", "p_type", 3).alias("alike"), F.format_string("%.2f", "p_retailprice").alias("fixed"), F.format_string("%06d|%s", "p_partkey", "p_brand").alias("formed"), more.escaped(F.concat(name, F.lit('\n"q"'))).alias("escaped"), listed.alias("listed"), more.quoted_item(listed, 1).alias("second"), more.with_word(name, F.lit("end")).alias("appended"), name.contains(F.col("p_brand")).alias("inside"))


@query("""SELECT event_id, epoch_us(ts) // 86400000000 AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, (s // 86400)::VARCHAR || 'd ' || lpad((s % 86400 // 3600)::VARCHAR, 2, '0') || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' AS took
FROM (SELECT *, event_id * 977 AS s FROM events)""")
def time_texts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), more.duration_text(F.col("event_id") * 977).alias("took"))


@query("""SELECT user_id, len(a) AS n, a[1:1] || a[3:] AS cut, list_prepend('new', a) AS before, list_position(a, 'click') - 1 AS click, coalesce(list_position(list_transform(a, lambda x: starts_with(x, 'pur')), true) - 1, -1) AS pur,
coalesce(list_position(list_transform(a, lambda x: ends_with(x, 'zz')), true) - 1, -1) AS zz, len(list_distinct(a)) AS kinds, list_contains(a, 'error') AS failed, list_sort(list_distinct(a)) = ['click', 'error'] AS both FROM (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)""")
def array_functions(spark: SparkSession, sf: str) -> DataFrame:
    a = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    rows = t(spark, sf, "events").groupBy("user_id").agg(a.alias("a"))
    cut = F.filter("a", lambda x, k: k != 1)
    return rows.select("user_id", F.size("a").cast("long").alias("n"), cut.alias("cut"), arrays.unshift("a", "new").alias("before"), F.nullif(more.wild_find("a", "whole", "click"), F.lit(-1)).alias("click"), more.wild_find("a", "left", "pur").alias("pur"), more.wild_find("a", "right", "zz").alias("zz"), F.size(F.array_distinct("a")).cast("long").alias("kinds"), F.array_contains("a", "error").alias("failed"), (F.array_sort(F.array_distinct("a")) == F.array(F.lit("click"), F.lit("error"))).alias("both"))


@query("""SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'private' WHEN user_id % 5 = 1 THEN 'loopback' WHEN user_id % 5 = 2 THEN 'link' WHEN user_id % 5 = 3 THEN 'multicast' ELSE 'public' END AS class, count(*) AS n FROM events GROUP BY ALL""")
def address_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Users by the class of an address made of their number."""
    head = F.element_at(F.array(*map(F.lit, ("10.", "127.", "169.254.", "230.", "8."))), (F.col("user_id") % 5 + 1).cast("int"))
    rest = F.when(F.col("user_id") % 5 == 2, F.concat((F.col("user_id") % 250).cast("string"), F.lit(".1"))).otherwise(F.concat((F.col("user_id") % 250).cast("string"), F.lit(".0.1")))
    return t(spark, sf, "events").groupBy("user_id", more.address_class(F.concat(head, rest)).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT 'c_name' AS name, 'text' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'c_acctbal', CASE WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN 'integer' ELSE 'number' END, count(*) FROM (SELECT printf('%.2f', c_acctbal) AS x FROM customer) GROUP BY ALL
UNION ALL SELECT 'c_custkey', 'integer', count(*) FROM customer""")
def column_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each column read as which kind."""
    shown = {"c_name": F.col("c_name"), "c_acctbal": F.format_string("%.2f", "c_acctbal"), "c_custkey": F.col("c_custkey").cast("string")}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("x")) for k, v in shown.items()])).alias("cell")
    return t(spark, sf, "customer").select(cells).groupBy("cell.name", more.column_kind("cell.x").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS turns, list(role ORDER BY turn, role, text) AS roles, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS missing, count(*) - count(DISTINCT turn) AS surplus, count(*) FILTER (text IS NULL OR length(text) < 10) AS short FROM conversations GROUP BY conv_id""")
def quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per conversation: turns, roles in order, and how many are missing, in surplus or short."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["role"])
    turns = F.countDistinct("turn")
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles"), (F.max("turn") - F.min("turn") + 1 - turns).alias("missing"), (F.count("*") - turns).alias("surplus"), F.count_if(F.col("text").isNull() | (F.length("text") < 10)).alias("short"))


@query("""SELECT event_id, 'k' AS name, props->>'k' AS value FROM events""")
def json_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every name and value of the JSON objects, a row each; malformed ones have none."""
    pairs = F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"})
    return t(spark, sf, "events").select("event_id", F.explode(pairs).alias("name", "value"))


@query("""SELECT user_id, to_json(list(json_object('t', event_type, 'v', value) ORDER BY ts, event_id))->>'$[0].t' AS first, count(*) AS length FROM events GROUP BY user_id""")
def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as one JSON array, and read again: its first element's name and its length."""
    rows = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))), lambda x: F.struct(x["event_type"].alias("t"), x["value"].alias("v"))))
    made = t(spark, sf, "events").groupBy("user_id").agg(rows.alias("j"))
    return made.select("user_id", F.get_json_object("j", "$[0].t").alias("first"), F.json_array_length("j").cast("long").alias("length"))
