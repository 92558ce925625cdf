"""Queries that apply the string, mathematics, array and map functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import arrays, maths, strings
from loomline.plans.registry import query
from loomline.session import table as t


@query(r"""SELECT p_partkey, regexp_replace('^1' || p_name || '^xF0a!', '\^([0-9]|x[0-9A-Fa-f]{3})', '', 'g') AS plain, length(p_name) + 1 AS visible,
CASE WHEN length(p_name) < 12 THEN rpad(p_name, 12, ' ') ELSE p_name END AS padded, CASE WHEN length(p_name) < 12 THEN lpad(p_name, 12, ' ') ELSE p_name END AS left_padded,
upper(p_name) AS up, replace(p_name, 'e', 'E') AS swapped, regexp_replace(p_name, '(?i)R', '#', 'g') AS swapped_any,
substr(p_name, greatest(length(p_name) - 4, 0) + 1) AS tail, CASE WHEN length(p_name) <= 2 THEN '' ELSE substr(p_name, 3, length(p_name) - 3) END AS middle,
instr(p_name, 'e') - 1 AS first_e, unicode(substr(p_name, 2, 1)) AS second_code FROM part""")
def string_builtins(spark: SparkSession, sf: str) -> DataFrame:
    name, marked = F.col("p_name"), F.concat(F.lit("^1"), F.col("p_name"), F.lit("^xF0a!"))
    return t(spark, sf, "part").select("p_partkey", strings.decolour(marked).alias("plain"), strings.visible_length(marked).alias("visible"), strings.pad_to(name, 12).alias("padded"), strings.pad_to(name, -12).alias("left_padded"), F.upper(name).alias("up"), strings.replace_text(name, "e", "E").alias("swapped"), strings.replace_text(name, "r", "#", True).alias("swapped_any"), strings.slice_text(name, -4, -1).alias("tail"), strings.slice_text(name, 2, -2).alias("middle"), strings.find_text(name, "e").alias("first_e"), strings.code_at(name, 1).alias("second_code"))


@query(r"""SELECT doc_id, string_split(text, ' ')[1] AS first, array_to_string(string_split(text, ' ')[1:3], ' ') AS three,
CASE WHEN instr(text, ' ') = 0 THEN '' ELSE substr(text, instr(text, ' ') + 1) END AS rest,
list_transform(regexp_extract_all(text, '("[^"]*"|[^\s"]+)'), lambda x: regexp_replace(regexp_replace(x, '^"', ''), '"$', '')) AS words, len(regexp_split_to_array(text, '\. |, ')) AS fields FROM documents""")
def tokenise(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", strings.first_word("text").alias("first"), strings.first_words("text", 3).alias("three"), strings.other_words("text").alias("rest"), strings.tokens("text").alias("words"), F.size(strings.split_any("text", [", ", ". "])).alias("fields"))


@query(r"""SELECT c_custkey, '\name\' || c_name || '\seg\' || c_mktsegment AS pairs, c_mktsegment AS seg, '' AS none,
'\name\' || c_name || '\seg\X' AS changed FROM customer""")
def pair_strings(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.concat(F.lit("\\name\\"), F.col("c_name"), F.lit("\\seg\\"), F.col("c_mktsegment"))
    rows = t(spark, sf, "customer").select("c_custkey", pairs.alias("pairs"))
    return rows.select("c_custkey", "pairs", strings.get_pair("pairs", "seg").alias("seg"), strings.get_pair("pairs", "void").alias("none"), strings.set_pair("pairs", "seg", "X").alias("changed"))


@query("""SELECT page_id, replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')') AS code, url AS back FROM pages""")
def percent_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's address, and decoded again."""
    code = strings.percent_encode("url")
    return t(spark, sf, "pages").select("page_id", code.alias("code"), F.url_decode(code).alias("back"))


@query("""SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
lpad((p_partkey * 7 // 3600)::VARCHAR, 2, '0') || ':' || lpad((p_partkey * 7 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((p_partkey * 7 % 60)::VARCHAR, 2, '0') AS clock,
p_size::DOUBLE AS number FROM part""")
def number_texts(spark: SparkSession, sf: str) -> DataFrame:
    size = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("mm"))
    return t(spark, sf, "part").select("p_partkey", strings.ordinal("p_partkey").alias("place"), strings.clock_text(F.col("p_partkey") * 7).alias("clock"), strings.number_of(size).alias("number"))


@query("""SELECT c_custkey, round(c_acctbal) AS away, greatest(0.0, least(c_acctbal, 5000.0)) AS clamped, trunc(c_acctbal)::BIGINT % 97 AS rest FROM customer""")
def rounding(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", maths.round_away("c_acctbal").alias("away"), maths.clamp("c_acctbal", 0.0, 5000.0).alias("clamped"), maths.remainder("c_acctbal", 97).alias("rest"))


@query("""SELECT p_partkey, round(p_retailprice * 0.75 + p_size * 0.25, 6) AS mixed, round(CASE WHEN r < 0.5 THEN p_size + (p_retailprice - p_size) * r * 2 WHEN r > 0.5 THEN p_retailprice + (0 - p_retailprice) * (r * 2 - 1) ELSE p_retailprice END, 6) AS three,
CASE WHEN p_retailprice <= 910 THEN 0.0 WHEN p_retailprice >= 990 THEN 1.0 ELSE round((p_retailprice - 910) / 80, 6) END AS mapped,
round(pow(0.5, greatest(910, least(p_retailprice, 990)) / 20 - 45.5), 9) AS half, abs(p_retailprice - 950) <= 0.01 * greatest(abs(p_retailprice), 950) AS near,
least(floor(log2(p_retailprice)), 23)::BIGINT AS log, round(p_retailprice / 2.5) * 2.5 AS step FROM (SELECT *, (p_partkey % 11) / 10 AS r FROM part)""")
def interpolation(spark: SparkSession, sf: str) -> DataFrame:
    price, r = F.col("p_retailprice"), (F.col("p_partkey") % 11) / 10
    return t(spark, sf, "part").select("p_partkey", F.round(maths.lerp(price, F.col("p_size"), F.lit(0.25)), 6).alias("mixed"), F.round(maths.lerp_three(F.col("p_size"), price, F.lit(0.0), r), 6).alias("three"), F.round(maths.remap(price, 910.0, 990.0, 0.0, 1.0, True), 6).alias("mapped"), F.round(maths.half_life(price, 910.0, 990.0, 20.0), 9).alias("half"), maths.almost(price, F.lit(950.0), 0.01).alias("near"), maths.floor_log2(price).alias("log"), maths.round_to(price, 2.5).alias("step"))


@query("""SELECT p_partkey, (p_partkey & -p_partkey) AS low, (p_partkey | 16) AS on4, (p_partkey & ~4) AS off2, xor(p_partkey, 1) AS flipped,
CASE WHEN p_size = 25 AND p_partkey = 1000 THEN 0 ELSE (trunc(degrees(atan2(p_partkey - 1000, p_size - 25)))::INT + 360) % 360 END AS yaw FROM part""")
def bits_and_angles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, sf, "part").select("p_partkey", maths.lowest_bit(k).alias("low"), maths.with_bit(k, 4, True).alias("on4"), maths.with_bit(k, 2, False).alias("off2"), maths.flip_bit(k, 0).alias("flipped"), maths.yaw(F.col("p_size") - 25, k - 1000).alias("yaw"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS len, round(v[2] * 3.0 - v[3] * 2.0, 5) AS c0, round(v[1] * v[1] + v[2] * 2.0, 5) AS d,
round(1 / (1 + exp(-v[1])), 5) AS sig, round(greatest(v[2], 0), 5) AS rel FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def vector_maths(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = t(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.round(maths.norm("v"), 5).alias("len"), F.round(maths.cross("v", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))[0], 5).alias("c0"), F.round(maths.dot(F.slice("v", 1, 2), F.array(F.col("v")[0], F.lit(2.0))), 5).alias("d"), F.round(maths.sigmoid(F.col("v")[0]), 5).alias("sig"), F.round(maths.relu(F.col("v")[1]), 5).alias("rel"))


@query("""SELECT user_id, array_to_string(a, '|') AS joined, a[1] AS head, a[:-2] AS popped, a[2:] AS shifted, list_append(a, 'end') AS pushed,
list_transform(a, lambda x, i: CASE WHEN i <> 2 THEN x END) AS holed, list_sort(a, 'DESC') AS down
FROM (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)""")
def string_buffers(spark: SparkSession, sf: str) -> DataFrame:
    a = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    rows = t(spark, sf, "events").groupBy("user_id").agg(a.alias("a"))
    return rows.select("user_id", arrays.implode("a", "|").alias("joined"), arrays.slot("a", 0).alias("head"), arrays.pop("a").alias("popped"), arrays.shift("a").alias("shifted"), arrays.push("a", "end").alias("pushed"), arrays.without_slot("a", 1).alias("holed"), arrays.sort_strings("a", descending=True).alias("down"))


@query("""SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT > 10""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    return t(spark, sf, "events").select("event_id", k.alias("k")).where("k > 10")


@query("""SELECT c_custkey, list_reduce(list_concat([65535], list_transform(string_split(c_name, ''), lambda x: ord(x))), lambda c, b: list_reduce(list_concat([xor(c, b * 256)], range(8)),
lambda x, i: CASE WHEN x & 32768 <> 0 THEN xor(x * 2, 4129) ELSE x * 2 END & 65535)) % 8192 AS bucket FROM customer""")
def crc16_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in 8192 buckets by the CRC-16 of their names."""
    return t(spark, sf, "customer").select("c_custkey", (maths.crc16("c_name") % 8192).alias("bucket"))
