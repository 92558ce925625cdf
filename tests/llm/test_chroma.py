import numpy as np
from pyspark.sql import functions as F

from loomline.llm import chroma
from loomline.llm.chroma import Block, fingerprint


def melody(seed, notes=90):
    rnd = np.random.default_rng(seed)
    t = np.arange(chroma.HOP) / chroma.RATE
    return (9000 * np.sin(2 * np.pi * (440 * 2 ** (rnd.integers(-24, 25, notes)[:, None] / 12)) * t)).ravel()


def pcm(x):
    return x.astype("<i2").tobytes()


def signed(x):
    return x.view(np.int32).tolist()


def test_cut_and_noise_align_and_others_do_not():
    whole = melody(1)
    full = fingerprint(whole)
    block = Block([(7, signed(full)), (8, signed(fingerprint(melody(2)))), (9, [])])
    noisy = fingerprint(whole[20 * chroma.HOP :] + np.random.default_rng(3).normal(0, 300, len(whole) - 20 * chroma.HOP))
    got = block.align(noisy)
    assert [g[0] for g in got] == [7] and got[0][1] == -20 and got[0][2] < 0.1 * got[0][3]
    assert block.align(fingerprint(melody(4))) == []
    assert block.align(full)[0][:3] == (7, 0, 0)


def test_silence_and_short_audio():
    assert len(fingerprint(np.zeros(100))) == 0
    quiet = fingerprint(np.zeros(chroma.FRAME + 40 * chroma.HOP))
    assert len(set(quiet.tolist())) == 1


def test_search_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(chroma, "BLOCK", 2)
    sounds = {k: pcm(melody(k % 6)[(k // 6) * 5 * chroma.HOP :]) for k in range(30)}
    rows = [(k * 50, x) for k, x in sounds.items()] + [(3, sounds[0]), (None, sounds[1]), (5, None), (7, b""), (9, b"\1")]
    prints = spark.createDataFrame(rows, "id long, audio binary").select("id", chroma.fingerprint_of(F.col("audio")).alias("codes"))
    got = {r.id: r for r in chroma.search(prints, F.col("id") % 100 == 0).collect()}
    assert len(got) == len(rows)
    codes = {i: fingerprint(np.frombuffer(x or b"", "<i2", len(x or b"") // 2)) for i, x in rows}
    for i, c in codes.items():
        same = [j for j, d in codes.items() if np.array_equal(c, d) and j is not None]
        hits = Block([(j, signed(d)) for j, d in codes.items() if j is not None and j % 100 == 0 and len(d)]).align(c)
        best = min(hits, key=lambda x: (x[2] / x[3], x[0])) if hits else (None,) * 4
        r = got[i]
        assert (r.class_id, r.n_aligned, (r.best_query, r.best_offset, r.bit_errors, r.bits)) == (min(same), len(hits), best)
    assert chroma.search(prints.limit(0), F.col("id") % 100 == 0).count() == 0


def test_melody_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, None, float("nan")]), (2, None), (3, [])], "id long, v array<float>")
    assert [len(r.a) for r in df.select(chroma.melody_of(F.col("v")).alias("a")).collect()] == [3 * 2 * chroma.HOP, 0, 0]


def test_queries_are_numbered_in_parts(spark):
    rows = spark.range(100).selectExpr("id * 7 % 101 AS query", "id AS h1", "-id AS h2")
    got = chroma.numbered(rows)
    assert [r.k for r in got.orderBy("query").collect()] == list(range(100))
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert chroma.numbered(rows.where("query < 0")).count() == 0
