"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character n-grams (hashed; n-grams that no few training
texts share are left out), so a misspelling shares most of the word's. Texts are read in windows of WINDOW
words; the mean of a window's word vectors goes into a linear softmax, and a text scores as its most
toxic window, so that length does not dilute it. Embeddings and softmax are trained together by Adagrad.

The training sample is bounded: at most MAX_PER_CLASS labelled texts of each class, those with the least digests
of their ids. Texts are whole both in training and in scoring. Null and empty texts are a window without
words and score by the bias alone. With only one class in the sample every score is that class's share.
Labels without an id or a value are left out; of several labels for an id the highest counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import fold, read_documents, texts
from loomline.session import table

MAX_PER_CLASS = {1: 900, 0: 1800}
WINDOW, DIM, BUCKETS, GRAMS, MIN_TEXTS, EPOCHS, RATE, SEED = 8, 8, 1 << 16, (3, 4, 5), 3, 12, 0.3, 1
_EDGE = ".,;:!?\"'()[]"


def subwords(word: str) -> list[int]:
    """Buckets of the n-grams of a word between marks of its start and end, and of the word."""
    raw = f"<{word.strip(_EDGE)}>".encode("utf-8", "surrogatepass")
    grams = {raw[k : k + n] for n in GRAMS for k in range(len(raw) - n + 1)} | {raw}
    return [zlib.crc32(g) % BUCKETS for g in grams]


class Model:
    def __init__(self, seed: int = SEED):
        rnd = np.random.default_rng(seed)
        self.emb = rnd.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.out = rnd.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.known = np.ones(BUCKETS, bool)
        self.share = None

    def fit(self, docs: list[str], toxic: list[int]) -> "Model":
        y = np.asarray(toxic, np.int64)
        if len(set(toxic)) < 2:
            self.share = float(y.mean()) if len(y) else 0.0
            return self
        memo: dict[str, int] = {}
        ids = [np.array([memo.setdefault(w, len(memo)) for w in d.lower().split()], np.int64) for d in docs]
        subs = [np.array(subwords(w), np.int64) for w in memo]
        of = np.repeat(np.arange(len(subs)), [len(s) for s in subs])
        flat = np.concatenate([np.zeros(0, np.int64), *subs])
        seen = np.zeros(BUCKETS, np.int64)
        for d in ids:
            if len(d):
                seen[np.unique(np.concatenate([subs[w] for w in set(d.tolist())]))] += 1
        self.known = seen >= MIN_TEXTS
        keep = self.known[flat]
        of, flat = of[keep], flat[keep]
        starts = np.searchsorted(of, np.arange(len(subs) + 1))
        rnd = np.random.default_rng(SEED)
        sq_e, sq_o, sq_b = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        weight = np.where(y == 1, 1.0, (y == 1).sum() / (y == 0).sum()).astype(np.float32)
        epochs = min(100, max(EPOCHS, 800 * 32 // max(1, len(docs))))  # small samples take more passes
        for epoch in range(epochs):
            for block in np.array_split(rnd.permutation(len(docs)), max(1, len(docs) // 32)):
                words = np.unique(np.concatenate([ids[d] for d in block]))
                n = starts[words + 1] - starts[words]
                w_of = np.repeat(np.arange(len(words)), n)
                s = flat[np.repeat(starts[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                scale = 1 / np.maximum(n, 1).astype(np.float32)
                vec = np.stack([np.bincount(w_of, self.emb[s, k], len(words)) for k in range(DIM)], 1) * scale[:, None]
                grad_w, grad_o, grad_b = np.zeros((len(words), DIM)), np.zeros((DIM, 2)), np.zeros(2)
                for d in block:
                    at = np.searchsorted(words, ids[d])
                    cut = np.arange(0, max(1, len(at)), WINDOW)
                    size = np.diff(np.append(cut, len(at)))
                    means = np.add.reduceat(vec[at], cut, axis=0) / size[:, None] if len(at) else np.zeros((1, DIM))
                    logit = means @ self.out + self.bias
                    # at first every window learns the label, then only the most toxic one
                    some = np.arange(len(cut)) if epoch == 0 else np.array([np.argmax(logit[:, 1] - logit[:, 0])])
                    p = np.exp(logit[some] - logit[some].max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    p[:, y[d]] -= 1
                    p *= weight[d] / len(some)
                    grad_o += means[some].T @ p
                    grad_b += p.sum(0)
                    if len(at):
                        back = p @ self.out.T / size[some, None]
                        for g, k in zip(back, some):
                            np.add.at(grad_w, at[cut[k] : cut[k] + WINDOW], g)
                live = np.flatnonzero(grad_w.any(1))
                hit = np.isin(w_of, live)
                g = (grad_w * scale[:, None])[w_of[hit]]
                spots, inv = np.unique(s[hit], return_inverse=True)
                g_e = np.stack([np.bincount(inv, g[:, k], len(spots)) for k in range(DIM)], 1)
                sq_e[spots] += (g_e**2).mean(1)
                self.emb[spots] -= (RATE * g_e / np.sqrt(sq_e[spots])[:, None]).astype(np.float32)
                sq_o += grad_o**2
                sq_b += grad_b**2
                self.out -= (RATE * grad_o / np.sqrt(sq_o)).astype(np.float32)
                self.bias -= (RATE * grad_b / np.sqrt(sq_b)).astype(np.float32)
        return self

    def scorer(self):
        """A function from texts to scores; the difference of the softmax's two inputs is linear in the embeddings, so a word is one number."""
        gram = (self.emb @ (self.out[:, 1] - self.out[:, 0])).tolist()
        value = [g if k else None for g, k in zip(gram, self.known.tolist())]
        bias = float(self.bias[1] - self.bias[0])
        memo: dict[str, float] = {}
        cores: dict[str, float] = {}

        def word(w: str) -> float:
            if len(memo) > 500_000:
                memo.clear()
                cores.clear()
            core = w.strip(_EDGE)
            if (out := cores.get(core)) is None:
                known = [v for b in subwords(core) if (v := value[b]) is not None]
                cores[core] = out = sum(known) / len(known) if known else 0.0
            memo[w] = out
            return out

        def score(text: str) -> float:
            if self.share is not None:
                return self.share
            words = text.lower().split()
            worst = 0.0
            if words:
                x = np.array([memo[w] if w in memo else word(w) for w in words])
                cut = np.arange(0, len(x), WINDOW)
                worst = float((np.add.reduceat(x, cut) / np.diff(np.append(cut, len(x)))).max())
            return float(1 / (1 + np.exp(-np.clip(worst + bias, -60, 60))))

        return score


def train(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits a model on a bounded sample of the labelled rows whose ids are not in fold 0."""
    most = MAX_PER_CLASS if most is None else most
    marked = labels.where("doc_id is not null and toxic is not null").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for label, n in most.items():
        # more than wanted, as labels may lack a document
        part = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        sample = part if sample is None else sample.unionByName(part)
    rows = texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")  # sum(most.values()) rows at most
    got = sorted(((r.doc_id, r.toxic, r.text) for r in rows.collect()), key=lambda r: (r[0], r[2]))
    return Model().fit([t for _, _, t in got], [int(x) for _, x, _ in got])


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * DIM numbers

    def run(text: pa.Array) -> pa.Array:
        score = _scorer(shared)
        return pa.array([score(x) for x in text.to_pylist()], pa.float64())

    rows = texts(docs, id_col, text_col).select("doc_id", F.arrow_udf(run, T.DoubleType())("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_SCORERS: dict[int, object] = {}


def _scorer(shared):
    """One scorer, with its memo, per broadcast model and Python worker."""
    if shared.value is not _SCORERS.get("model"):
        _SCORERS.update(model=shared.value, score=shared.value.scorer())
    return _SCORERS["score"]


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; rows without an id are not held out, nor learned from."""
    docs = read_documents(spark, sf_dir)
    out = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
