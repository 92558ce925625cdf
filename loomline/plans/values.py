"""Queries of nested JSON and of functions on numbers, vectors, versions, boxes and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import arrays, maths, strings
from loomline.plans.registry import query
from loomline.session import table as t
from loomline.sources import nested


@query("""WITH e AS (SELECT event_id AS id, user_id, event_type, event_id % 3 AS rest, props->>'k' AS k FROM events),
r AS (SELECT id, unnest([['', 'props tags user'], ['user', user_id::VARCHAR], ['tags.length', '2'], ['tags.0', event_type], ['tags.1.length', '1'], ['tags.1.0', rest::VARCHAR], ['props', 'k'], ['props.k', k]]) AS p FROM e) SELECT id, p[1] AS path, p[2] AS value FROM r""")
def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Events as nested JSON, taken apart into dotted paths again."""
    text = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"tags":["'), "event_type", F.lit('",['), (F.col("event_id") % 3).cast("string"), F.lit(']],"props":'), "props", F.lit("}"))
    return nested.flattened(t(spark, sf, "events").select("event_id", text.alias("j")), "event_id", "j")


@query("""SELECT p_partkey, list_sum(list_transform(range(16), lambda k: (((p_size >> k::INT) & 1)::BIGINT << (2 * k)) + (((p_partkey % 64 >> k::INT) & 1)::BIGINT << (2 * k + 1))))::BIGINT AS code FROM part""")
def part_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Size and number of parts with their bits interleaved."""
    return t(spark, sf, "part").select("p_partkey", maths.morton2("p_size", F.col("p_partkey") % 64).alias("code"))


@query("""SELECT s_suppkey, '''' || (s_suppkey % 10) || '.5 ' || s_nationkey || '.0 ' || (s_suppkey // 2) || CASE WHEN s_suppkey % 2 = 1 THEN '.5' ELSE '.0' END || '''' AS shown, [s_suppkey % 10 + 0.5, s_nationkey, s_suppkey / 2]::DOUBLE[] AS again FROM supplier""")
def supplier_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as text, and read from it again."""
    made = t(spark, sf, "supplier").select("s_suppkey", strings.vector_text(F.array(F.col("s_suppkey") % 10 + 0.5, F.col("s_nationkey").cast("double"), F.col("s_suppkey") / 2)).alias("shown"))
    return made.withColumn("again", strings.vector_of("shown"))


_VERSION = "(k % 3) || '.' || CASE WHEN k % 7 = 0 THEN 'git' ELSE (k % 11) || CASE WHEN k % 5 = 0 THEN 'RC' WHEN k % 5 = 1 THEN 'beta' ELSE '' END END"
_KEY = "list_transform(string_split(v, '.'), lambda p: {'n': CASE WHEN lower(p) = 'git' THEN 4611686018427387904 ELSE coalesce(TRY_CAST(regexp_extract(p, '^[0-9]+') AS BIGINT), -1) END, 't': lower(regexp_replace(p, '^[0-9]+', ''))})"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k FROM orders), a AS (SELECT o_orderkey, {_VERSION} AS v FROM o), b AS (SELECT o_orderkey, {_VERSION.replace('k %', '(k + 4) %')} AS v FROM o)
SELECT a.o_orderkey, a.v AS one, b.v AS other, x < y AS older FROM (SELECT *, {_KEY} AS x FROM a) AS a JOIN (SELECT *, {_KEY} AS y FROM b) AS b USING (o_orderkey)""")
def version_order(spark: SparkSession, sf: str) -> DataFrame:
    """Whether one version, made of an order's number, is older than another."""

    def version(k):
        tail = F.when(k % 5 == 0, "RC").when(k % 5 == 1, "beta").otherwise("")
        return F.concat((k % 3).cast("string"), F.lit("."), F.when(k % 7 == 0, F.lit("git")).otherwise(F.concat((k % 11).cast("string"), tail)))

    key = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select("o_orderkey", version(key).alias("one"), version(key + 4).alias("other"))
    return rows.withColumn("older", strings.version_key("one") < strings.version_key("other"))


@query("""SELECT event_id, CASE WHEN user_id % 2 <> 1 THEN round(10 + (value - 10) * (3 - user_id % 2) / (1 - user_id % 2), 6) END AS between_ FROM events""")
def between_times(spark: SparkSession, sf: str) -> DataFrame:
    """From ten to an event's value as time goes on; null where no time goes by."""
    return t(spark, sf, "events").select("event_id", F.round(maths.lerp_between(F.lit(10.0), "value", (F.col("user_id") % 2).cast("double"), F.lit(1.0), F.lit(3.0)), 6).alias("between_"))


@query("""WITH p AS (SELECT p_partkey, (p_size % 3)::DOUBLE AS a, (p_partkey % 7 - 3)::DOUBLE AS b, (p_partkey % 5 - 2)::DOUBLE AS c FROM part), d AS (SELECT *, b * b - 4 * a * c AS d FROM p)
SELECT p_partkey, CASE WHEN a = 0 THEN b <> 0 OR c = 0 ELSE d >= 0 END AS real, round(CASE WHEN a = 0 THEN CASE WHEN b <> 0 THEN -c / b WHEN c = 0 THEN 0 END WHEN d >= 0 THEN (-b - sqrt(greatest(d, 0))) / (2 * a) END, 9) + 0 AS x0,
round(CASE WHEN a = 0 THEN CASE WHEN b <> 0 THEN -c / b WHEN c = 0 THEN 0 END WHEN d >= 0 THEN (-b + sqrt(greatest(d, 0))) / (2 * a) END, 9) + 0 AS x1 FROM d""")
def part_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Roots of a curve for each part: of squares, lines and constants."""
    p, n = F.col("p_partkey"), lambda c: c.cast("double")
    r = maths.roots(n(F.col("p_size") % 3), n(p % 7 - 3), n(p % 5 - 2))
    return t(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.real", *[(F.round(F.col(f"r.{x}"), 9) + 0).alias(x) for x in ("x0", "x1")])


@query("""SELECT p_partkey, p_size >= 5 AND p_size + 2 <= 45 AND p_retailprice / 20 >= 46 AND p_retailprice / 20 + 2 <= 90 AND p_partkey % 50 >= 0 AND p_partkey % 50 + 2 <= 40 AS inside FROM part""")
def boxes_within(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a part's box lies in a larger one."""
    lo = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 20, (F.col("p_partkey") % 50).cast("double"))
    rows = t(spark, sf, "part").select("p_partkey", lo.alias("lo")).withColumns({"hi": F.transform("lo", lambda x: x + 2), "low": F.array(*map(F.lit, (5.0, 46.0, 0.0))), "high": F.array(*map(F.lit, (45.0, 90.0, 40.0)))})
    return rows.select("p_partkey", maths.box_within("lo", "hi", "low", "high").alias("inside"))


@query("""SELECT event_id, [event_type, CASE WHEN event_id % 2 = 0 THEN props END, NULL, NULL, 'x'] AS grown, CASE WHEN event_id % 2 = 0 THEN [event_type, props, 'y'] ELSE [event_type, 'y'] END AS filled FROM events""")
def slots(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of an event with a slot set beyond their end, and with the first hole filled."""
    a = F.array("event_type", F.when(F.col("event_id") % 2 == 0, F.col("props")))
    rows = t(spark, sf, "events").select("event_id", a.alias("a"))
    return rows.select("event_id", arrays.with_slot("a", 4, "x").alias("grown"), arrays.add_free("a", "y").alias("filled"))
