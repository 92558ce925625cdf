"""The log tail over files that grow, shrink and are replaced, across restarts of the stream."""

import pytest

from loomline.streaming import tail


@pytest.fixture
def log(spark, tmp_path):
    spark.dataSource.register(tail.LogTail)
    (tmp_path / "logs").mkdir()

    def run():
        """One run of the stream, from its checkpoint, over what is there."""
        stream = spark.readStream.format("log_tail").option("path", str(tmp_path / "logs")).option("glob", "*.log").option("chunk", "16").load()
        rows = []
        q = stream.writeStream.foreachBatch(lambda df, _: rows.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None
        return sorted(rows)

    return tmp_path / "logs", run


def test_lines_once_over_restarts(log):
    at, run = log
    (at / "a.log").write_bytes(b"one\ntwo\nhal")
    (at / "b.log").write_bytes(b"no end yet")
    (at / "c.txt").write_bytes(b"not asked for\n")
    assert run() == [("a.log", 0, "one", False), ("a.log", 4, "two", False)]
    with open(at / "a.log", "ab") as f:
        f.write("f done\n\nlast, gr\xfc\xdf\n".encode())
    with open(at / "b.log", "ab") as f:
        f.write(b"\n\xff bad byte\n")
    assert run() == [("a.log", 8, "half done", False), ("a.log", 18, "", False), ("a.log", 19, "last, grüß", False), ("b.log", 0, "no end yet", False), ("b.log", 11, "� bad byte", False)]
    (at / "a.log").write_bytes(b"short\n")  # cut off
    (at / "b.log").write_bytes(b"another file that is longer than the first one was\nx\n")  # replaced
    assert run() == [("a.log", 0, "short", True), ("b.log", 0, "another file that is longer than the first one was", True), ("b.log", 51, "x", True)]
    with open(at / "a.log", "ab") as f:
        f.write(b"more\n")
    (at / "b.log").unlink()
    assert run() == [("a.log", 6, "more", False)]


def test_parts_hold_every_line_once(tmp_path):
    lines = [b"", b"x" * 40, b"y", b"", b"z" * 15, b"w" * 16, b"v" * 17, b""]
    (tmp_path / "f.log").write_bytes(b"\n".join(lines) + b"\ntail")
    for chunk in (1, 2, 7, 16, 17, 1000):
        files = tail._Files({"path": f"file://{tmp_path}", "chunk": str(chunk)})
        got = [r for p in files.parts({}, files.ends()) for r in files.lines(p)]
        assert [r[2].encode() for r in got] == lines and [r[1] for r in got] == [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]


def test_empty_and_missing(tmp_path):
    (tmp_path / "e.log").write_bytes(b"")
    files = tail._Files({"path": str(tmp_path)})
    assert files.parts({}, files.ends()) == []
    assert tail._Files({"path": str(tmp_path / "none")}).ends() == {"files": {}}


def test_batch(spark, tmp_path):
    spark.dataSource.register(tail.LogTail)
    (tmp_path / "a").write_bytes(b"1\n2\n3")
    assert [r.line for r in spark.read.format("log_tail").option("path", str(tmp_path)).load().orderBy("at").collect()] == ["1", "2"]
