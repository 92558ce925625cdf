"""Fields of lines, digests, calendars, grids, places and sets, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import graphs, windows
from loomline.plans.graphs import _EDGES, supply_edges
from loomline.plans.registry import query
from loomline.session import table as t


@query("""SELECT doc_id, i AS place, p[4 * i + 1] AS first, p[4 * i + 2] AS second, p[4 * i + 3] AS third, p[4 * i + 4] AS fourth
FROM (SELECT doc_id, p, unnest(range(0, len(p) // 4)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE NOT contains(text, chr(13)) AND NOT contains(text, '<')) WHERE len(p) % 4 = 0)""")
def line_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a text in groups of four; a text with a return, a mark of HTML or lines left over is refused whole."""
    rows = t(spark, sf, "documents").where(~F.col("text").contains("\r") & ~F.col("text").contains("<")).select("doc_id", F.split("text", "\n").alias("p"))
    rows = rows.where(F.size("p") % 4 == 0).select("doc_id", "p", F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / 4) - 1)).alias("place"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), *[F.col("p")[(F.col("place") * 4 + k).cast("int")].alias(name) for k, name in enumerate(("first", "second", "third", "fourth"))])


@query("""SELECT source, count(*) AS lines, count(*) FILTER (trim(line) = '') AS blank, count(*) FILTER (regexp_matches(line, '[0-9]')) AS digits, count(*) FILTER (starts_with(line, 'http')) AS links
FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""")
def log_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by source, and how many are blank, hold digits or begin with a link."""
    rows = t(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("source").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") == "").alias("blank"), F.count_if(F.col("line").rlike("[0-9]")).alias("digits"), F.count_if(F.col("line").startswith("http")).alias("links"))


@query("""SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) AS number, TRY_CAST(regexp_extract(url, 'page=([0-9]+)', 1) AS DOUBLE) AS page FROM pages""")
def matched_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers found by a pattern; null where it does not match."""
    found = lambda p: F.regexp_extract("url", p, 1).try_cast("double")
    return t(spark, sf, "pages").select("page_id", found("/([0-9]+)").alias("number"), found("page=([0-9]+)").alias("page"))


@query("""SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents""")
def text_digests(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("""SELECT p_partkey, chr((65 + p_size % 26)::INTEGER) AS letter, translate(p_name, 'abcdefghij', '0123456789') AS digits, strpos(p_name, string_split(p_name, ' ')[2]) - 1 AS second_at, list_filter(string_split(p_type, ' '), lambda x: x <> 'STEEL') AS rest FROM part""")
def letters_and_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A letter by its code, letters turned to digits, where the second token begins, and a list without one value."""
    second = F.get(F.split("p_name", " "), F.lit(1))
    return t(spark, sf, "part").select("p_partkey", F.char(65 + F.col("p_size") % 26).alias("letter"), F.translate("p_name", "abcdefghij", "0123456789").alias("digits"), (F.expr("locate(get(split(p_name, ' '), 1), p_name)").cast("long") - F.when(second.isNotNull(), 1)).alias("second_at"), F.array_remove(F.split("p_type", " "), "STEEL").alias("rest"))


@query("""SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS said FROM orders""")
def calendar_days(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("said"))


@query("""SELECT p_partkey, unnest(range(p_size // 5, (p_size + p_partkey % 7) // 5 + 1)) AS cell, greatest(10, least(30, p_size))::BIGINT AS clamped, (p_size % 3 * 3 + p_partkey % 3) * 3 + (p_size + p_partkey) % 3 AS wave FROM part""")
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of five that a range covers, its start clamped to a box, and the wave of its place on a grid."""
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    cells = F.sequence(F.floor(size / 5), F.floor((size + key % 7) / 5))
    wave = (F.pmod(size, F.lit(3)) * 3 + F.pmod(key, F.lit(3))) * 3 + F.pmod(size + key, F.lit(3))
    return t(spark, sf, "part").select("p_partkey", F.explode(cells).alias("cell"), F.greatest(F.lit(10), F.least(F.lit(30), size)).cast("long").alias("clamped"), wave.alias("wave"))


@query("""SELECT o_orderkey, row_number() OVER w - 1 AS place, (sum((o_orderstatus = 'O')::INTEGER) OVER w)::BIGINT - (o_orderstatus = 'O')::INTEGER AS kept_before FROM orders WINDOW w AS (ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def kept_places(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's place among all by price, and how many of the kept ones come before it: a kept one's place among those."""
    rows = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "O").alias("kept"))
    return windows.global_places(rows, ["o_totalprice", "o_orderkey"], F.col("kept")).select("o_orderkey", "place", "kept_before")


@query("""SELECT l_suppkey, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS fixed, bit_or(1::BIGINT << l_linenumber) AS mask, list_sort(list(DISTINCT l_linenumber)) AS members FROM lineitem GROUP BY ALL""")
def destination_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by supplier and flag: their sum, and the union of their numbers as bits and as a list."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_linenumber"))
    return t(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("fixed"), F.bit_or(bit).alias("mask"), F.array_sort(F.collect_set("l_linenumber")).alias("members"))


@query("""SELECT DISTINCT least(a, b) AS low, greatest(a, b) AS high FROM (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem UNION ALL SELECT l_partkey, l_suppkey FROM lineitem UNION ALL SELECT l_suppkey, l_linenumber FROM lineitem) WHERE a <> b""")
def neighbour_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Links of three sources, each unordered pair once."""
    rows = t(spark, sf, "lineitem")
    pair = lambda a, b: rows.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    links = pair("l_suppkey", "l_partkey").unionByName(pair("l_partkey", "l_suppkey")).unionByName(pair("l_suppkey", "l_linenumber"))
    return links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


@query("""WITH l AS (SELECT user_id, max(epoch_us(ts)) AS seen FROM events GROUP BY 1) SELECT user_id, seen, greatest(0, (SELECT count(*) FROM l) - 10) AS evicted FROM l ORDER BY seen DESC, user_id LIMIT 10""")
def newest_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A table of ten places: the users seen last stay, and how many gave way."""
    last = t(spark, sf, "events").groupBy("user_id").agg(F.max(windows.micros("ts")).alias("seen"))
    gone = last.agg(F.greatest(F.lit(0), F.count("*") - 10).alias("evicted"))
    return last.orderBy(F.desc("seen"), "user_id").limit(10).crossJoin(F.broadcast(gone))


@query("""SELECT o_custkey, arg_max(o_orderkey, (-p, ln((h + 1) / 4294967297.0) / o_totalprice, o_orderkey)) AS chosen FROM (SELECT *, left(o_orderpriority, 1)::INTEGER AS p, ('0x' || left(md5('draw:' || o_orderkey), 8))::BIGINT AS h FROM orders WHERE o_totalprice > 0) GROUP BY o_custkey""")
def weighted_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Of each customer's most urgent orders one, drawn by weight: the greatest logarithm of a seeded number over the weight."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("draw:"), F.col("o_orderkey").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
    draw = F.ln((h + 1) / 4294967297.0) / F.col("o_totalprice")
    urgent = -F.substring("o_orderpriority", 1, 1).cast("int")
    return t(spark, sf, "orders").where("o_totalprice > 0").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(urgent, draw, F.col("o_orderkey"))).alias("chosen"))


@query("""SELECT vec_id, (s + 2) // 4 AS place, round(coalesce(CASE WHEN s >= 0 THEN v[s + 1] END, 0) + coalesce(CASE WHEN s >= -1 THEN v[s + 2] END, 0) + coalesce(v[s + 3], 0) + coalesce(v[s + 4], 0), 5) AS total, round(list_sum(v[9:16]), 5) AS masked, len(v) AS size
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(-2, 63, 4)) AS s FROM embeddings)""")
def strided_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of four at a stride of four, with two zeros before and behind; the sum of places 8 to 15, others masked; and the array's length in its stead."""
    at = lambda k: F.coalesce(F.get("v", (F.col("s") + k).cast("int")), F.lit(0.0))
    rows = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(-2), F.lit(62), F.lit(4))).alias("s"))
    masked = F.aggregate(F.transform("v", lambda x, i: F.when((i >= 8) & (i < 16), x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.floor((F.col("s") + 2) / 4).alias("place"), F.round(at(0) + at(1) + at(2) + at(3), 5).alias("total"), F.round(masked, 5).alias("masked"), F.size("v").cast("long").alias("size"))


@query("""SELECT p_partkey, coalesce(price, p_retailprice) AS price FROM part LEFT JOIN (SELECT l_partkey, min(l_extendedprice) AS price FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) ON l_partkey = p_partkey""")
def scattered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of seventh lines put over those of their parts; parts without one keep their own."""
    new = t(spark, sf, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_extendedprice").alias("price"))
    return t(spark, sf, "part").join(new, "p_partkey", "left").select("p_partkey", F.coalesce("price", "p_retailprice").alias("price"))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES}) WHERE src % 7 <> 0 AND dst % 7 <> 0), r(node, level) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(level) AS level FROM r GROUP BY node""")
def masked_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from part 1 over the graph of parts, those that 7 divides left out."""
    return graphs.bfs(supply_edges(spark, sf).where("src % 7 <> 0 AND dst % 7 <> 0"), spark.range(1, 2).select(F.col("id").alias("node")))
