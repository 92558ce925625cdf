import random
import re
import zlib
from collections import Counter

import pytest

from loomline.llm import spelling as S
from loomline.llm.common import texts
from loomline.session import Scratch
from tests.llm.helpers import documents, edge_rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, letters):
    out = Counter()
    for i, t, _ in rows:
        for run in RUN.findall(t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            run = run if h % S.MISSPELT else run[:k] + run[k + 1 :]
            if len(run) >= letters:
                out[run] += 1
    return out


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(counts, ratio):
    near = {a: [b for b in counts if one_apart(a, b)] for a in counts}
    form = {}
    for a in counts:
        best = min(near[a], key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= ratio * counts[a] else None
    out = []
    for a in counts:
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, form[a], root, counts[a], len(near[a]), counts.get(form[a])))
    return sorted(out)


def found(spark, counts, ratio=2):
    out = S.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), ratio)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()))


def test_counts(spark):
    rows = [*edge_rows(), (8, "Écoles Élan ÉCOLES ×÷abc aßc " + "longest" * 4000 + "ĀwordŸs naïve", "a"), *[(k, "misspelling these words happens " * 3, "b") for k in range(300)]]
    got = S.word_counts(texts(documents(spark, rows)), 3).collect()
    assert {r.word: r.n for r in got} == dict(counted(rows, 3))
    assert any(one_apart(r.word, w) for r in got for w in ("misspelling", "words", "happens", "these"))


def test_misspellings_of_a_batch_add_up(spark):
    rows = [(k, "bookkeeper, aaaaaaaa", "a") for k in range(8000)]
    want = counted(rows, S.LETTERS)
    got = S.word_counts(texts(documents(spark, rows).coalesce(1))).collect()
    assert {r.word: r.n for r in got} == dict(want) and want["aaaaaaa"] > 20
    assert sum(r.n for r in got) == 2 * len(rows)


def test_neighbours_of_random_words(spark):
    rnd = random.Random(4)
    counts = {"".join(rnd.choice("aabé") for _ in range(rnd.randrange(1, 8))): rnd.choice([1, 1, 2, 5, 20, 100]) for _ in range(500)}
    assert found(spark, counts) == brute(counts, 2)


def test_hard_words(spark):
    counts = {"aaaaaa": 9, "aaaaa": 9, "aaaaaaa": 81, "baaaaa": 9, "aaaaab": 3, "x": 1, "y": 1, "xy": 1, "yx": 1, "long" * 300: 7, "long" * 300 + "s": 70, "alone": 2}
    assert found(spark, counts) == brute(counts, 2)


def test_long_chain_of_forms(spark):
    word, counts = "abcdefghijklmnopq", {}
    for k in range(12):
        counts[word[k:]] = 3**k
    got = found(spark, counts, 3)
    assert got == brute(counts, 3)
    assert {r[2] for r in got} == {word[11:]}


def test_pairs_meet_once_and_nodes_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(S, "SHALLOW", 0)  # all but the roots by a join
    words = ["hello", "helo", "hallo", "hullo", "hell", "heello", "llo"]
    with Scratch(spark) as tables:
        pairs = S.neighbours(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), tables).collect()
        nodes = S.node_pairs(spark.createDataFrame([("abab", 1), ("ab", 1)], "word string, n long"), tables).collect()
    assert sorted((p.word, p.near) for p in pairs) == sorted((a, b) for a in words for b in words if one_apart(a, b))
    assert len({r.before for r in nodes}) == 5 and len({r.behind for r in nodes}) == 5


def test_empty(spark):
    assert S.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert S.word_counts(texts(documents(spark, [(1, None, None), (2, "", None), (3, "1 2 . 一", None)]))).collect() == []


def test_query(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(None if k % 40 == 0 else k, " ".join(["committee", "Comittee" if k % 9 == 0 else "committees", "straße", "strasse", "weiter" * (k % 3)]), "a") for k in range(200)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, S.op11_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.sql(S.ORACLE).project("word, form, root, n, n_near, form_n").fetchall(), key=repr)
    kept = {w: n for w, n in counted(rows, S.LETTERS).items() if n >= S.TIMES}
    assert got == sorted(brute(kept, S.RATIO), key=repr)


def test_only_nodes_of_few_letters_are_broadcast(spark):
    def joins(df):
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")

    with Scratch(spark) as tables:
        words = tables.written(spark.range(400).selectExpr("concat('word', id) AS word", "id AS n"), "words")  # a small table, which Spark would broadcast with all that is exploded from it
        rows = words.selectExpr("word", "explode(sequence(0, length(word))) AS at").selectExpr("word", "substring(word, 1, at) AS prefix")
        assert joins(S._numbered(rows, "prefix", "before", tables)) == (1, 1)
        assert joins(S.neighbours(words, tables)) == (0, 2)
