import hashlib
import random
from collections import Counter

import pytest
from tests.llm.helpers import documents, edge_rows

from loomline.llm import suffix_dedup
from loomline.llm.suffix_dedup import LENGTH, drop_repeats, remove_repeats


def brute(texts, LENGTH=LENGTH):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[k : k + LENGTH] for r in raws for k in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - LENGTH + 1):
            if n[r[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(n))


def hard_rows():
    rnd = random.Random(11)
    shared = prose(rnd, 150)
    rows = edge_rows()
    for k in range(40):  # a passage at any place, with some of its edges alike
        a = rnd.randrange(0, 120)
        rows.append((100 + k, prose(rnd, rnd.randrange(0, 60)) + rnd.choice(["", " x ", "yz"]) + shared[a : a + rnd.choice([398, 399, 400, 401, 403, 440, 700])] + rnd.choice(["", " x ", "yz"]) + prose(rnd, rnd.randrange(0, 60)), "a"))
    base = prose(rnd, 400)
    for k in range(12):  # near copies
        at = rnd.randrange(len(base))
        rows.append((200 + k, base[:at] + rnd.choice(["", "Q", "QQ"]) + base[at + rnd.randrange(3) :], "b"))
    rows += [(300, "ab " * 400, "c"), (301, "ab " * 140, "c"), (302, "z" * 400, "c"), (303, "z" * 401, "c"), (304, "y" * 399, "c"), (305, prose(rnd, 300) * 2, "c"), (306, "q" * 400, "c")]
    return rows


@pytest.mark.parametrize("per_core,per_task", [(1000, 3000), (3, 20)])
def test_against_brute_force(spark, monkeypatch, per_core, per_task):
    monkeypatch.setattr(suffix_dedup, "PER_CORE", per_core)
    monkeypatch.setattr(suffix_dedup, "PER_TASK", per_task)
    rows = hard_rows()
    got = remove_repeats(documents(spark, rows), digest=True).select("row.doc_id", "repeats.*").drop("kept").collect()
    want = [(i, *x) for (i, _, _), x in zip(rows, brute([t for _, t, _ in rows]))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("length", [56, 256])
def test_other_lengths(spark, length):
    rows = hard_rows()
    got = remove_repeats(documents(spark, rows), digest=True, length=length).select("row.doc_id", "repeats.*").drop("kept").collect()
    want = [(i, *x) for (i, _, _), x in zip(rows, brute([t for _, t, _ in rows], length))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        remove_repeats(documents(spark, rows), length=40)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 2048)
    rows = hard_rows()
    docs = documents(spark, rows).selectExpr("doc_id as id", "coalesce(text, '') as text", "xxhash64(text) as tkey").toArrow()
    texts = docs["text"].to_pylist()
    for batch in suffix_dedup._runs(LENGTH)(docs.to_batches()):
        for r in batch.to_pylist():
            text = next(t for i, t, k in zip(docs["id"].to_pylist(), texts, docs["tkey"].to_pylist()) if k == r["tkey"] and i == r["id"]).encode()
            p, before, after = r["at"] >> 32, r["at"] >> 16 & 0xFFFF, r["at"] & 0xFFFF
            assert 0 <= after <= before <= LENGTH - 24
            assert p - after + LENGTH <= len(text)


def test_drop(spark):
    docs = documents(spark, hard_rows())
    out = drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 5").first().text is None
    assert drop_repeats(documents(spark, [])).count() == 0


def test_drop_holds_one_worker_a_task(spark):
    """The texts that remove_repeats leaves, by a single function in Python."""
    docs = documents(spark, hard_rows())
    out = drop_repeats(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = [None if r.row.text is None else r.repeats.kept.decode("utf-8", "ignore") for r in remove_repeats(docs).collect()]
    assert sorted(map(repr, (r.text for r in out.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("shorter", [56, 256, LENGTH])
def test_shorter_strings_counted(spark, shorter):
    """n_repeated against brute force; what is removed stays what its own length alone removes."""
    rows = hard_rows()
    docs = documents(spark, rows)
    got = remove_repeats(docs, digest=True, shorter=shorter).selectExpr("row.doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256", "n_repeated").collect()
    texts = [t for _, t, _ in rows]
    want = [(i, *x, y[1]) for (i, _, _), x, y in zip(rows, brute(texts), brute(texts, shorter))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        remove_repeats(docs, shorter=LENGTH + 1)


def test_query_tells_passages_of_over_50_words(spark, tmp_path):
    """A shared passage of 51 words and under 400 bytes: left in place, as the contract asks, but told."""
    rnd = random.Random(5)
    passage = " ".join("".join(rnd.choice("abcde") for _ in range(5)) for _ in range(51))
    rows = [(1, f"{prose(rnd, 80)} {passage} {prose(rnd, 90)}", "a"), (2, f"{prose(rnd, 70)} {passage} {prose(rnd, 60)}", "a"), (3, prose(rnd, 200), "a"), (4, None, "b")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) < LENGTH
    assert [got[k].n_removed for k in (1, 2, 3, 4)] == [0, 0, 0, 0]
    assert got[1].n_repeated_256 == got[2].n_repeated_256 == len(passage) + 2  # and the spaces around it
    assert got[3].n_repeated_256 == got[4].n_repeated_256 == 0
