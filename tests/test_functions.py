"""Scalar functions, sources and sinks on literal cases."""

import zipfile

from pyspark.sql import functions as F

from loomline.functions import arrays, maths, strings
from loomline.sources import sinks, text
from loomline.streaming import keyed


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_strings(spark):
    s = F.lit("abcdef")
    r = one(spark, a=strings.slice_text(s, -3, -1), b=strings.slice_text(s, 1, -2), c=strings.slice_text(s, 9, 2), d=strings.find_text(s, "cd", 3), e=strings.find_text(s, "cd", 99), f=strings.code_at(s, 2), g=strings.code_at(s, 6), h=strings.decolour(F.lit("^1a^xF0Fb^^2")), i=strings.percent_encode(F.lit("a b*(c)!~'é")), j=strings.number_of(F.lit(" -2.5e1x")), k=strings.number_of(F.lit("x")))
    assert r.asDict() == {"a": "def", "b": "bcde", "c": "", "d": -1, "e": -1, "f": 99, "g": 0, "h": "ab^", "i": "a%20b%2A(c)!~'%C3%A9", "j": -25.0, "k": 0.0}
    r = one(spark, a=strings.tokens(F.lit('one "two words" three')), b=strings.ordinal(F.lit(112)), c=strings.clock_text(F.lit(3725)), d=strings.get_pair(F.lit("\\a\\1\\b\\2\\a\\3"), "a"), e=strings.set_pair(F.lit("\\b\\2\\a\\1"), "c", "9"), f=strings.vector_text(strings.vector_of(F.lit("'1 2.5 x'"))))
    assert r.asDict() == {"a": ["one", "two words", "three"], "b": "112th", "c": "01:02:05", "d": "1", "e": "\\a\\1\\b\\2\\c\\9", "f": "'1.0 2.5 0.0'"}
    v = spark.createDataFrame([("1.10",), ("1.9",), ("1.9a",), ("1",), ("1.git",)], "v string")
    assert [x.v for x in v.orderBy(strings.version_key("v")).collect()] == ["1", "1.9", "1.9a", "1.10", "1.git"]


def test_maths(spark):
    r = one(spark, a=maths.round_away(F.lit(-2.5)), b=maths.yaw(F.lit(0.0), F.lit(-1.0)), c=maths.half_life(F.lit(5.0), 0.0, 10.0, 5.0), d=maths.roots(F.lit(1.0), F.lit(-3.0), F.lit(2.0)), e=maths.reflect(F.array(F.lit(1.0), F.lit(-1.0)), F.array(F.lit(0.0), F.lit(1.0))), f=maths.angle_between(F.lit(350.0), F.lit(10.0)), g=maths.crc16(F.lit("123456789")), h=maths.morton2(F.lit(3), F.lit(1)), i=maths.unit(F.array(F.lit(0.0), F.lit(0.0))), j=maths.remainder(F.lit(-7.9), 3), k=maths.floor_log2(F.lit(2.0**30)))
    assert (r.a, r.b, r.c, (r.d.x0, r.d.x1, r.d.real), r.e, r.f, r.g, r.h, r.i, r.j, r.k) == (-3.0, 270, 0.5, (1.0, 2.0, True), [1.0, 1.0], -20.0, 0x29B1, 7, [0.0, 0.0], -1, 23)


def test_arrays(spark):
    a = F.array(F.lit("b"), F.lit(None).cast("string"), F.lit("a"))
    r = one(spark, a=arrays.implode(a, "+"), b=arrays.add_free(a, "x"), c=arrays.with_slot(a, 4, "y"), d=arrays.sort_strings(a), e=arrays.pop(F.array().cast("array<string>")), f=arrays.slot(a, 9))
    assert r.asDict() == {"a": "b+a", "b": ["b", "x", "a"], "c": ["b", None, "a", None, "y"], "d": ["a", "b", None], "e": [], "f": None}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("G dm\nx 1 2 3\nlone\ny 4\nG ctf\nx 5\n")
    lines = text.numbered_lines(spark, str(tmp_path / "a.txt"))
    got = [(r.key, r.value, r.data, r.carried) for r in text.tagged_lines(lines, "G").orderBy("line").collect()]
    assert got == [("G", "dm", None, "dm"), ("x", "1", "2 3", "dm"), ("y", "4", None, "dm"), ("G", "ctf", None, "ctf"), ("x", "5", None, "ctf")]
    assert [r.fields for r in text.records_of(lines, 4).collect()] == [["G dm", "x 1 2 3", "lone", "y 4"]]
    (tmp_path / "e.txt").write_text("// note\n0 0 0*3 4 0\n3 4 0*0 0 0\nbad*1\n1 2*3 4 5\n")
    assert [(r.a, r.b, r.length) for r in text.edge_list(text.numbered_lines(spark, str(tmp_path / "e.txt"))).collect()] == [([0.0] * 3, [3.0, 4.0, 0.0], 5.0)]
    (tmp_path / "j.tsv").write_text("1\t2\n3\nx\t1\n4\t5\n")
    assert [(r.a, r.b) for r in text.journal(spark, str(tmp_path / "j.tsv"), ["a", "b"]).collect()] == [(1.0, 2.0), (4.0, 5.0)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m/one.txt", "1")
        z.writestr("two.bin", "2")
    assert [(r.member, bytes(r.content)) for r in text.archive_members(spark, str(tmp_path / "z.zip"), ".txt").collect()] == [("m/one.txt", b"1")]
    assert text.listing(spark, str(tmp_path), "*.txt").count() == 2
    e = spark.createDataFrame([(0, 1, 2.5)], "src long, dst long, weight double")
    assert [r.value for r in sinks.matrix_market_lines(e).collect()] == ["%%MatrixMarket matrix coordinate real general", "2 2 1", "1 2 2.5"]
    assert [r.value for r in sinks.dot_lines(e).collect()] == ["  n0 -> n1;"]
    sinks.append_json(e, str(tmp_path / "out"), "r1")
    sinks.append_json(e, str(tmp_path / "out"), "r2")
    assert {r.run for r in spark.read.json(str(tmp_path / "out")).collect()} == {"r1", "r2"}


def test_latest_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:05", 2.0), (2, "2024-01-01 00:00:01", 9.0), (1, "2024-01-01 00:00:03", 3.0)]
    spark.createDataFrame(rows, "key long, at string, value double").select("key", F.col("at").cast("timestamp"), "value").write.parquet(str(tmp_path / "in"))
    # timeouts by the clock would call for batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema("key long, at timestamp, value double").parquet(str(tmp_path / "in"))
    q = keyed.stream_latest(stream, "key", "at", "value").writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = {r.key: r.value for r in spark.table("latest").orderBy("at_us").collect()}
    assert last == {1: 2.0, 2: 9.0}


def test_zeros_and_gaps(spark):
    n, z = F.lit(None).cast("double"), F.lit(0.0)
    r = one(spark, line=maths.roots(z, F.lit(2.0), F.lit(-6.0)), all=maths.roots(z, z, z), none=maths.roots(z, z, F.lit(1.0)), same=maths.lerp_between(z, F.lit(1.0), z, z, F.lit(0.5)), flat=maths.remap(F.lit(1.0), 2.0, 2.0, 0.0, 1.0), crc=maths.crc16(F.lit("")), none_crc=maths.crc16(F.lit(None).cast("string")), e=maths.roots(n, z, z))
    assert (tuple(r.line), tuple(r.all), tuple(r.none), r.same, r.flat, r.crc, r.none_crc) == ((3.0, 3.0, True), (0.0, 0.0, True), (None, None, False), None, None, 0xFFFF, None)
    r = one(spark, between=maths.lerp_between(F.lit(1.0), F.lit(3.0), z, F.lit(4.0), F.lit(1.0)), mid=maths.median3(F.lit(3.0), F.lit(1.0), F.lit(2.0)), pre=strings.same_prefix(F.lit("ABx"), F.lit("aby"), 2), many=F.size(strings.pairs_of(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda k: F.concat(F.lit("\\k"), k.cast("string"), F.lit("\\v")))))))
    assert r.asDict() == {"between": 1.5, "mid": 2.0, "pre": True, "many": 6000}
    lines = spark.createDataFrame([("'0 0 0'*'3 4 0'",), ("1 1 1*1 1 1",), ("nan 0 0*1 1 1",), ("// x",), (None,), ("1 2 3",)], "text string")
    assert [(r.a, r.b, r.length) for r in text.edge_list(lines).collect()] == [([0.0] * 3, [3.0, 4.0, 0.0], 5.0)]
    assert tuple(text.malformed_edges(lines).first()) == (6, 1, 3)
