import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tests.llm.helpers import documents, edge_rows

from loomline.llm import simhash
from loomline.llm.common import components


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(fps, names, most=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, n in enumerate(names):
        r = find(i)
        least[r] = min((x for x in (least.get(r), n) if x is not None), default=None)
    return [least[find(i)] for i in range(len(fps))]


def clustered(n, seed=1):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = rnd.choice(centres)
        for _ in range(rnd.randrange(6)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


def test_index_finds_every_pair():
    codes = np.array(clustered(700), np.uint64)
    index = simhash.GrayIndex(codes)
    for most in (0, 1, 2, 3):
        q, at = index.search(codes, most)
        got = set(zip(codes[q].tolist(), index.codes[at].tolist()))
        assert got == {(int(a), int(b)) for a in codes for b in codes if (int(a) ^ int(b)).bit_count() <= most}


def test_links_through_many_levels(spark):
    codes = clustered(500, 3)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    links = simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long"), leaf=16, step=5)
    found = {r.node: r.component for r in components(links).collect()}
    want = brute_components(codes, signed)
    assert [found.get(x, x) for x in signed] == want


def test_components_on_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}


def test_documents(spark):
    base = " ".join(f"word{k % 211} tail" for k in range(900))
    rows = edge_rows() + [(20 + k, base.replace("word7 ", f"new{k} ", 1), "a") for k in range(12)] + [(50, base.upper(), "b"), (None, base, "b"), (60, "two words", None), (61, "TWO  words", None)]
    docs = documents(spark, rows)
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = list(zip([i for i, _, _ in rows], fps, brute_components(fps, [i for i, _, _ in rows])))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, {c for _, _, c in want}))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_first(documents(spark, [(None, "x", "a"), (None, "x", "a")])).count() == 1


def test_spark_and_xxhash_agree(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("naïve").cast("string"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("naïve".encode(), 42)
