import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from loomline.llm import divergence as D
from loomline.session import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, a int"


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least, top):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    seen, count = Counter(), Counter()
    for t, lang, s in rows:
        seen.update((lang, w) for w in set(terms_of(t)))
        count.update((lang, s, w) for w in terms_of(t))
    kept = defaultdict(list)
    for (lang, w), n in seen.items():
        if n >= least:
            kept[lang].append(w)
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    out, groups = [], defaultdict(set)
    for _, lang, s in rows:
        groups[lang].add(s)
    for lang, sources in groups.items():
        words, v = kept[lang], len(kept[lang])
        total = {s: sum(count[lang, s, w] for w in words) for s in sources}
        p = {(s, w): share(count[lang, s, w], total[s], v) for s in sources for w in words}
        q = {w: share(sum(count[lang, s, w] for s in sources), sum(total.values()), v) for w in words}
        for s in sources:
            pair = [(-sum(abs(p[s, w] - p[o, w]) for w in words), o.encode(), o) for o in sources if o != s]
            term = [(q[w] - p[s, w], w.encode(), w) for w in words if count[lang, s, w] and p[s, w] > q[w]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(sorted(items)[:most])]
    return sorted(out)


def corpus():
    rnd, rows = random.Random(3), []
    words = ["Red", "red", "blé", "ÉCOLE", "école", "a", "ab", "abc", "abcd", "abcde", "日本語", "x" * 70, "x" * 69 + "y", "don't", "w1w", "tie", "eit"]
    for k in range(300):
        text = "".join(rnd.choice(words) + rnd.choice([" ", "\n", "1", "_", ".", "\x7f", "\x00"]) for _ in range(rnd.randrange(12)))
        rows.append((None if k % 50 == 0 else k, text, rnd.choice(["en", "fr", None, ""]), rnd.choice("stuvwxyz") if k % 7 else None))
    rows += [(900, None, "en", "s"), (901, "", "xx", "alone"), (902, "rare words only", "yy", "p"), (903, None, "yy", "q"), (904, "only " * 40, "zz", "p")] + [(5, "same row twice", "en", "t")] * 3
    return rows


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(D, "TERMS", 3)
    monkeypatch.setattr(D, "TILE", 2)
    monkeypatch.setattr(D, "ROWS", 4)  # beyond that prefixes are joined


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def test_against_brute_force(spark, small):
    rows = corpus()
    got = D.audit(frame(spark, rows).repartition(5), least=5, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 3)


def test_rare_prefixes_are_discarded(spark):
    """Words that share no frequent prefix are dropped at the first level; a prefix is kept by the rows that hold it, not by its words."""
    rows = [(k, f"zz{chr(97 + k % 26)}qqqq {'kk' if k % 2 else ''}{chr(97 + k % 26)}w common", "en", "s") for k in range(52)] + [(99, " ".join(f"pp{chr(97 + k)}" for k in range(26)), "en", "s")]
    told = D.gathered(D.lean_batches(frame(spark, rows)).select("lang", "source", "text").coalesce(1))
    with Scratch(spark) as tables:
        kept = D.frequent_terms(told, 30, tables)
        assert [tuple(r) for r in kept.collect()] == [("en", bytearray(b"common"))]
        levels = [spark.read.parquet(p).collect() for p in tables.paths[:-1]]
    assert {bytes(r.term) for r in levels[0]} == {b"zz", b"co"}  # 26 words of one row make no frequent prefix
    assert {bytes(r.term) for r in levels[1]} == {b"comm"}


def test_terms():
    texts = ["", "A1b", "é", "x", "", "yz", "Z", "日 本"]
    own, code, terms = D.term_codes(pa.array(texts))
    assert [(o, terms[c].as_py().decode()) for o, c in zip(own, code)] == [(k, w) for k, t in enumerate(texts) for w in terms_of(t)]


def test_empty(spark):
    assert D.audit(frame(spark, []), 2).collect() == []
    assert D.audit(frame(spark, [(1, None, None, None)]), 2).collect() == []
    two = D.audit(frame(spark, [(1, None, None, "a"), (2, None, None, "b")]), 2).collect()
    assert sorted(map(tuple, two)) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]
