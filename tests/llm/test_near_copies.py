import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import documents, edge_rows
from tests.llm.test_suffix_dedup import prose

from loomline.llm import near_copies
from loomline.llm.common import row_key


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(x, y):
    return x == y or 10 * len(x & y) >= 8 * len(x | y)


def brute_kept(rows):
    sets, root = [brute_set(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (n, _, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((n is None, n or 0))
    return sorted(min(g) for g in groups.values())


def changed(rnd, words, n):
    out = list(words)
    for k in rnd.sample(range(len(out)), n):
        out[k] = f"new{rnd.random()}"
    return " ".join(out)


def some_rows():
    """Pairs around 0.8 to 0.95, a group of near copies, a chain and one common line."""
    rnd, rows, pairs = random.Random(4), edge_rows(), []
    line = prose(rnd, 20)
    for k in range(60):
        words = [f"p{k}w{j}" for j in range(200)]
        rows += [(100 + 2 * k, " ".join(words) + " " + line, "a"), (101 + 2 * k, changed(rnd, words, 1 + k % 6) + " " + line, "a")]
        if similar(brute_set(rows[-2][1]), brute_set(rows[-1][1])):
            pairs.append(101 + 2 * k)
    words = [f"g{j}" for j in range(300)]
    rows += [(1000 + k, changed(rnd, words, 2), "b") for k in range(40)]
    rows += [(2000 + k, " ".join(f"c{j}" for j in range(9 * k, 9 * k + 150)), "b") for k in range(12)]
    rows += [(None, "just two", "b"), (None, "JUST  two", "b"), (None, "another text", "b")]
    rnd.shuffle(rows)
    return rows, pairs


@pytest.mark.parametrize("small", [32, 2])
def test_against_brute_force(spark, small):
    rows, _ = some_rows()
    docs = documents(spark, rows)
    kept = near_copies.keep_first(docs, small=small)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == brute_kept(rows)
    assert near_copies.keep_first(documents(spark, [])).count() == 0


def test_pipeline_takes_near_copies_out(spark):
    """At 0.8 and over, simhash's 2 bits of three-word shingles miss nearly all of these."""
    rows, pairs = some_rows()
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    assert len(pairs) >= 30 and not kept & set(pairs)
    assert len(kept & set(range(1000, 1040))) == 1 and kept & set(range(2000, 2012)) == {2000}


def test_fingerprints_find_the_closest_pairs_without_bands(spark):
    """Within 2 bits and similar: linked by the Gray-order index alone; within 2 bits and unlike: not linked."""
    rnd, rows, want = random.Random(5), [], set()
    for k in range(40):
        words = [f"p{k}w{j}" for j in range(400)]
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(words[1:]), "a")]
        x, y = (near_copies.fingerprint(near_copies.shingles(t)) for _, t, _ in rows[-2:])
        if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
            want.add((2 * k, 2 * k + 1))
    texts = documents(spark, rows).select("doc_id", "text").withColumn("tkey", row_key())
    sketch = texts.select("doc_id", "tkey", near_copies._sketch("text").alias("s")).select("doc_id", "tkey", "s.node", F.expr("array()").cast("array<bigint>").alias("bands"), "s.fp")
    named = lambda x: {r.node: r.component for r in near_copies.link(x, texts).collect()}
    of, found = {r.doc_id: r.node for r in sketch.collect()}, named(sketch)
    assert len(want) >= 20 and all(found[of[a]] == found[of[b]] for a, b in want)
    assert len({x for x in found.values()}) == len(want) == len(found) // 2
    found = near_copies.link(sketch.withColumn("fp", F.lit(7).cast("long")), texts)  # all in one place of the index
    assert found is None or found.count() == 2


def test_large_buckets_take_two_component_searches(spark, monkeypatch):
    """A bucket of 150 texts of which many are unlike, in parts of some texts each: all pairs are compared, in two searches at most."""
    rnd, searches, found = random.Random(6), [], near_copies.components
    words = [f"g{j}" for j in range(120)]
    rows = [(k, changed(rnd, words, 1 + k % 5), "b") for k in range(150)]
    monkeypatch.setattr(near_copies, "components", lambda *x: searches.append(x) or found(*x))
    monkeypatch.setattr(near_copies, "PART", 1000, raising=False)
    texts = documents(spark, rows).select("doc_id", "text").withColumn("tkey", row_key())
    sketch = texts.select("doc_id", "tkey", near_copies._sketch("text").alias("s")).select("doc_id", "tkey", "s.node", F.expr("array(1L, 2L)").alias("bands"), "s.fp")
    of = {r.doc_id: r.node for r in sketch.collect()}
    named = {r.node: r.component for r in near_copies.link(sketch, texts).collect()}
    groups = {}
    for k, node in of.items():
        groups.setdefault(named.get(node, node), []).append((False, k))
    assert sorted(min(g) for g in groups.values()) == brute_kept(rows)
    assert 2 < len(groups) < 140 and len(searches) <= 2
