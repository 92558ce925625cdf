import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tests.llm.helpers import documents
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_suffix_dedup import prose

from loomline.llm import mixing
from loomline.llm.quality_rules import _measure
from loomline.llm.tokens import load


def rows_of():
    rnd = random.Random(9)
    rows = [(k, prose(rnd, rnd.randrange(25, 200)), f"s{k % 3}") for k in range(50)]
    shared = prose(rnd, 150)
    rows += [(100 + k, prose(rnd, 30) + " " + shared + " " + prose(rnd, 30), "s1") for k in range(6)]
    short = prose(rnd, 51)  # over 50 words, and under 400 bytes
    assert corpus_pipeline.REPEAT <= len(short.encode()) < 400
    rows += [(400 + k, prose(rnd, 40 + k) + " " + short + " " + prose(rnd, 50 - k), "s0") for k in range(4)]
    rows += [(200 + k, rows[k][1], "s2") for k in range(10)]
    rows += [(300, None, "s0"), (301, "", None), (302, "x " * 80, "s0"), (303, "few words", "s1"), (304, "a b c d e " * 60, None)]
    return rows


def cut(texts):
    raws = [t.encode() for t in texts]
    n = Counter(r[k : k + corpus_pipeline.REPEAT] for r in raws for k in range(len(r) - corpus_pipeline.REPEAT + 1))
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - corpus_pipeline.REPEAT + 1):
            if n[r[k : k + corpus_pipeline.REPEAT]] > 1:
                gone[k : k + corpus_pipeline.REPEAT] = b"\1" * corpus_pipeline.REPEAT
        yield bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore")


def test_run_against_brute_force(spark, tmp_path):
    rows = rows_of()
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t, s) for i, t, s in rows if t and _measure(t)[0] >= 20 and 100 * _measure(t)[4] <= 30 * _measure(t)[0]]
    one = corpus_pipeline.quality(spark, docs, "")
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {i for i, _, _ in kept}
    fps = [brute_fingerprint(t) for _, t, _ in kept]
    names = brute_components(fps, [i for i, _, _ in kept])
    kept = [r for r, n in zip(kept, names) if r[0] == n]
    two = corpus_pipeline.near_duplicates(spark, one, "")
    assert {r.doc_id for r in two.collect()} == {i for i, _, _ in kept}
    left = dict(zip([i for i, _, _ in kept], cut([t for _, t, _ in kept])))
    three = corpus_pipeline.repeats(spark, two, "")
    assert {r.doc_id: r.text for r in three.collect()} == left and len(left[100]) < 400
    passage = next(t for i, t, _ in rows if i == 400).split()[40:91]
    assert not any(" ".join(passage[2:-2]) in t for t in left.values())
    taken = {r.doc_id: r.taken for r in mixing.mix(three).collect()}
    four = corpus_pipeline.mixture(spark, three, "").collect()
    got = Counter()
    for r in four:
        assert left[r.doc_id].startswith(r.text)
        got[r.doc_id] += len(r.text.split())
    assert got == +Counter(taken)
    tok = load(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, tuple(tok.encode(r.text, add_special_tokens=False).ids)) for r in four)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want


def test_nothing_left(spark):
    docs = documents(spark, [(1, None, "a"), (2, "", None), (None, "x", "a")])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
