import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm.helpers import documents, edge_rows

from loomline.llm import recurrent_lm as lm


def corpus(n=240):
    rnd = random.Random(4)
    return [(1000 + k, " ".join(f"{a}{j % 7}" for j in range(rnd.randrange(3, 60)) for a in ("ab", "Cd", "ef")) + rnd.choice(["", f" rare{k % 9} once{k}"]), "a") for k in range(n)]


def net_and_docs(seed, sizes, dtype=np.float32):
    rnd = np.random.default_rng(seed)
    net = lm.Net(-np.sort(-rnd.integers(1, 50, 70)).astype(float), end=3, hidden=5, dtype=dtype)
    used = net.views(np.ones_like(net.flat))["ww"]
    used[-1, :, 70 % lm.CLASS :] = 0  # places without a symbol
    mask = net.views(np.ones_like(net.flat))
    mask["ww"][:] = used
    net.flat += np.concatenate([mask[k].ravel() for k in net.shapes]) * rnd.normal(0, 0.25, net.flat.shape).astype(dtype)
    return net, [np.append(np.delete(np.arange(70), 3)[rnd.integers(0, 69, n)], 3).astype(np.int16) for n in sizes]


def plain(net, doc):
    """One symbol at a time, one document at a time, with the softmax over classes and the one within the class written out."""
    p, H = {k: v.astype(np.float64) for k, v in net.p.items()}, net.hidden
    sigmoid = lambda x: 1 / (1 + math.e ** -x)
    h, before, total = np.zeros(H), net.end, 0.0
    for y in doc.tolist():
        g, a = p["emb"][before] @ p["w"] + p["b"], h @ p["u"]
        z, r = sigmoid(g[:H] + a[:H]), sigmoid(g[H : 2 * H] + a[H : 2 * H])
        h = (1 - z) * h + z * np.tanh(g[2 * H :] + r * a[2 * H :])
        one = np.append(h, 1)
        outer, inner = one @ p["wc"], (one @ p["ww"][y // lm.CLASS])[: min(lm.CLASS, net.n - y // lm.CLASS * lm.CLASS)]
        total += outer[y // lm.CLASS] - math.log(np.exp(outer).sum()) + inner[y % lm.CLASS] - math.log(np.exp(inner).sum())
        before = y
    return total


def test_scores_are_those_of_a_plain_forward_pass():
    net, docs = net_and_docs(6, (5, 0, 90, 33, 200))
    want = [plain(net, d) for d in docs]
    assert np.allclose(net.score(docs), want, rtol=1e-4)
    assert np.allclose(net.score(docs, window=7), want, rtol=1e-4)
    assert np.allclose([net.score([d])[0] for d in docs], want, rtol=1e-4)


def test_gradients_are_those_of_the_plain_forward_pass():
    net, docs = net_and_docs(3, (5, 3, 9, 0), np.float64)
    y, _ = lm.lay_out(docs, 2)
    [(_, x, fresh, yy, live)] = net.windows(y, 100)
    flat = np.empty_like(net.flat)
    net.gradients(x, fresh, yy, live, np.zeros((5, x.shape[1])), flat)
    rnd, start, grads = np.random.default_rng(1), net.flat.copy(), net.views(flat)
    for k, part in net.views(np.arange(len(start))).items():
        for i in rnd.choice(part[-1, :, 0].ravel() if k == "ww" else part.ravel(), 4):
            sides = []
            for step in (1e-5, -1e-5):
                net.load(start.copy())
                net.flat[i] += step
                sides.append(-sum(plain(net, d) for d in docs))
            assert abs((sides[0] - sides[1]) / 2e-5 - flat[i]) < 1e-4 * max(1, abs(flat[i])), k
    assert set(grads) == {"emb", "w", "u", "b", "wc", "ww"}


def test_training_lowers_the_loss_and_carries_the_state_over_windows():
    net, _ = net_and_docs(8, ())
    docs = [np.append(np.tile([5, 17, 40, 9], 60)[: 50 + 37 * k], 3).astype(np.int16) for k in range(5)]
    first, sums = net.score(docs).sum(), np.full_like(net.flat, 1e-2)
    for _ in range(30):
        net.train(lm.lay_out(docs, 3)[0], sums)
    assert net.score(docs).sum() > first / 3


def test_probabilities_sum_to_one():
    net, _ = net_and_docs(5, ())
    h = np.random.default_rng(5).normal(0, 1, (1, 5)).astype(np.float32)
    assert abs(sum(math.exp(net.log_probs(h, np.array([k]))[0][0]) for k in range(70)) - 1) < 1e-4


def test_groups_hold_long_texts_whole(monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 50)
    docs = [np.arange(n, dtype="<i2") for n in (10, 500, 45, 5, 1)]
    batch = pa.RecordBatch.from_pydict({"symbols": pa.array([d.tobytes() for d in docs], pa.binary())})
    assert [[len(d) for d in g] for g in lm.grouped(iter([batch]))] == [[10, 500], [45, 5, 1]]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 20)
    monkeypatch.setattr(lm, "VOCAB", 12)
    rows = edge_rows() + corpus()
    got = lm.score_texts(documents(spark, rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for i, t, _ in rows if not held(i) for w in toks(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(toks(t)), sum(counts[w] > 0 for w in toks(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), 4)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if held(r.doc_id) and r.doc_id >= 1000]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in got)
    by_id = Counter((r.doc_id, r.score) for r in got if r.doc_id == 7)
    assert list(by_id.values()) == [2]
    copies = [(5000 + k, rows[-1][1] if k % 2 else "ties " * 40, "a") for k in range(60)]
    alike = lm.score_texts(documents(spark, rows + copies).repartition(7, "doc_id")).collect()
    assert [len({(r.base_score, r.score) for r in alike if r.doc_id in [i for i, t, _ in rows + copies if t == text]}) for text in ("ties " * 40, rows[-1][1])] == [1, 1]
    assert lm.score_texts(documents(spark, [])).count() == 0
    lone = lm.score_texts(documents(spark, [(1, "a b", "x")] if held(1) else [(next(k for k in range(99) if held(k)), "a b", "x")])).collect()
    assert lone[0].train_tokens == 0 and lone[0].n_known == 0


def test_query_with_null_and_repeated_ids(spark, tmp_path):
    documents(spark, edge_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op10_recurrent_lm(spark, str(tmp_path)).collect()
    assert len(got) == len(edge_rows()) and all(isinstance(r.held_out, bool) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
