"""A gated recurrent language model in numpy that scores whole documents.

The alphabet of the net is the end of a text, the VOCAB most frequent words, and TAILS tails: all other words,
dealt by their last two bytes; a tail's word is then weighed by its smoothed count. The output softmax is
factored by class: frequent symbols, then less frequent ones, CLASS to a class. All training documents are read
once, in ROUNDS of parts of the corpus: each task trains on its own documents by truncated
backpropagation over windows of STEPS tokens or more, carrying the state from window to window until a document ends,
and the tasks' parameters are averaged by Spark, weighted by tokens, before the next round. Parts are dealt by a
hash, but tasks as the tables lie in files, so scores of another layout differ a little; base scores do not.

Counts cover all training documents. Texts are cut into words twice: to count them, and to write each document's
symbols, which the rounds and the scoring read. The TOP most frequent words' counts are broadcast; other words meet
theirs in a join. Null and empty texts are an end alone. Repeated rows give a row each, and equal texts score alike:
the blocks in which they are scored round differently, so all rows of a text take the least of its scores. Very long texts
are laid out whole. Columns other than the id and the text are not looked at, whatever their names. Rows
without an id are never held out, so they are learned from. Without training documents counts are zero, and
base_score and score are those of one unseen symbol per token. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import fold, merged, read_documents, texts, word_codes
from loomline.session import written

VOCAB, TAILS, CLASS, TOP = 800, 64, 30, 524_288
HIDDEN, STEPS, STREAMS, RATE, SEED = 16, 16, 384, 0.05, 1
#: Tokens that a task lays out at once; a longer text is laid out whole.
GROUP = 4_000_000
#: Sixteenths of the training documents in each round.
ROUNDS = (range(1), range(1, 3), range(3, 7), range(7, 16))
FOLD = 1


def lay_out(docs: list[np.ndarray], streams: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Documents end to end in parallel streams, longest first onto the shortest: symbols (step, stream), -1 where none, and each one's (stream, step)."""
    streams = max(1, min(streams, len(docs)))
    heap = [(0, s) for s in range(streams)]
    at = [(0, 0)] * len(docs)
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        length, s = heapq.heappop(heap)
        at[d] = (s, length)
        heapq.heappush(heap, (length + len(docs[d]), s))
    heap.sort(reverse=True)  # longest stream first, so that those still running are the first ones
    column = {s: k for k, (_, s) in enumerate(heap)}
    at = [(column[s], t) for s, t in at]
    y = np.full((heap[0][0], streams), -1, np.int16)
    for d, (s, t) in enumerate(at):
        y[t : t + len(docs[d]), s] = docs[d]
    return y, at


class Net:
    """Parameters as one vector with views by name, and how they run. Symbols are numbered by falling frequency, so that a class is CLASS
    neighbours; frequencies set the output biases, so an untrained net scores by frequency. States and gates are (unit, stream) blocks."""

    def __init__(self, freq: np.ndarray, end: int = 0, hidden: int = HIDDEN, seed: int = SEED, dtype=np.float32):
        n, rnd = len(freq), np.random.default_rng(seed)
        classes = -(-n // CLASS)
        f = np.zeros(classes * CLASS)
        f[:n] = np.asarray(freq, np.float64) + 0.5
        f = f.reshape(classes, CLASS)
        by = f.sum(1)
        shapes = {"emb": (n, hidden), "w": (hidden, 3 * hidden), "u": (hidden, 3 * hidden), "b": (3 * hidden,), "wc": (hidden + 1, classes), "ww": (classes, hidden + 1, CLASS)}
        self.n, self.end, self.hidden, self.shapes = n, end, hidden, shapes
        self.load(np.zeros(sum(int(np.prod(s)) for s in shapes.values()), dtype))
        for k in ("emb", "w", "u"):
            self.p[k][:] = rnd.normal(0, 0.15, shapes[k])
        self.p["wc"][-1] = np.log(by / by.sum())
        with np.errstate(divide="ignore"):
            self.p["ww"][:, -1] = np.maximum(np.log(f / by[:, None]), -1e9)  # places without a symbol never have any weight

    def load(self, flat: np.ndarray) -> "Net":
        self.flat, self.p = flat, self.views(flat)
        return self

    def copy(self) -> "Net":
        out = object.__new__(Net)
        out.__dict__ |= self.__dict__
        return out.load(self.flat.copy())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "p"}  # views would be copies

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.p = self.views(self.flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            size = int(np.prod(s))
            out[k] = flat[at : at + size].reshape(s)
            at += size
        return out

    def states(self, x, fresh, h, kept: dict | None = None):
        """The state before each symbol is told, as (step, unit, stream), over a window; x: symbols before, fresh: where a document starts."""
        p, H = self.p, self.hidden
        steps, streams = x.shape
        gates = np.ascontiguousarray((p["emb"] @ p["w"] + p["b"])[x].transpose(0, 2, 1))
        u, new = np.ascontiguousarray(p["u"].T), fresh.any(1)
        own = {k: np.empty((steps, m * H, streams), gates.dtype) for k, m in (("h0", 1), ("a", 3), ("zr", 2), ("n", 1), ("h", 1))}
        for t in range(steps):
            h0, a, zr, n, out = (own[k][t] for k in ("h0", "a", "zr", "n", "h"))
            h0[:] = h
            if new[t]:
                h0[:, fresh[t]] = 0
            np.matmul(u, h0, out=a)
            np.add(gates[t, : 2 * H], a[: 2 * H], out=zr)
            np.negative(zr, out=zr)
            np.exp(np.minimum(zr, 60, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[H:], a[2 * H :], out=n)
            n += gates[t, 2 * H :]
            np.tanh(n, out=n)
            np.subtract(n, h0, out=out)
            out *= zr[:H]
            out += h0
            h = out
        if kept is not None:
            kept |= own
        return own["h"], h

    def log_probs(self, hs, y, grads: dict | None = None):
        """Natural log probability of each symbol y from its state, a row each; with grads, sets the output's gradients and returns those of the states."""
        p, N, H = self.p, len(y), self.hidden
        c = (y // CLASS).astype(np.int16)
        order = np.argsort(c, kind="stable")  # by class, so that a class is a slice
        one = np.ones((N, H + 1), hs.dtype)  # the last column meets the biases
        one[:, :H] = hs[order]
        y, c = y[order], c[order]
        ends = np.searchsorted(c, np.arange(len(p["wc"][0]) + 1, dtype=np.int16)).tolist()
        own = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
        rows, places = np.arange(N), y % CLASS
        outer, inner = one @ p["wc"], np.empty((N, CLASS), hs.dtype)
        for k, s in own:
            np.matmul(one[s], p["ww"][k], out=inner[s])
        logp, back = outer[rows, c] + inner[rows, places], None
        for logits in (outer, inner):
            np.exp(np.minimum(logits, 60, out=logits), out=logits)  # 60: far above any trained value, far below overflow
            total = logits @ np.ones(logits.shape[1], hs.dtype)
            logp -= np.log(total)
            if grads is not None:
                logits *= (1 / total)[:, None]
        if grads is not None:
            outer[rows, c] -= 1
            inner[rows, places] -= 1
            np.matmul(one.T, outer, out=grads["wc"])
            part = outer @ p["wc"][:H].T
            for k, s in own:
                np.matmul(one[s].T, inner[s], out=grads["ww"][k])
                part[s] += inner[s] @ p["ww"][k, :H].T
            back = np.empty_like(part)
            back[order] = part
        out = np.empty_like(logp)
        out[order] = logp
        return out, back

    def windows(self, y: np.ndarray, steps: int):
        """Windows over laid-out streams: (first step, symbols before, where documents start, symbols, which are symbols); with fewer streams, more steps."""
        before = np.vstack([np.full((1, y.shape[1]), self.end, y.dtype), np.maximum(y[:-1], 0)])
        fresh = np.vstack([np.ones((1, y.shape[1]), bool), (y[:-1] == self.end) | (y[:-1] < 0)])
        t = 0
        while t < len(y):
            some = int((y[t] >= 0).sum())  # streams that still run are the first ones
            to = t + min(4 * steps, max(steps, steps * y.shape[1] // max(1, 2 * some)))
            yield t, before[t:to, :some], fresh[t:to, :some], y[t:to, :some], y[t:to, :some].ravel() >= 0
            t = to

    def gradients(self, x, fresh, y, live, h, flat: np.ndarray):
        """Fills flat with the gradients of a window's negated log probabilities; returns the state behind the window."""
        p, H, kept, flat[:] = self.p, self.hidden, {}, 0
        g = self.views(flat)
        hs, h = self.states(x, fresh, h, kept)
        steps, _, streams = hs.shape
        _, back = self.log_probs(hs.transpose(0, 2, 1).reshape(-1, H)[live], y.ravel()[live], g)
        dhs = np.zeros((steps * streams, H), hs.dtype)
        dhs[live] = back
        dhs = np.ascontiguousarray(dhs.reshape(steps, streams, H).transpose(0, 2, 1))
        h0, n, z, r, a = kept["h0"], kept["n"], kept["zr"][:, :H], kept["zr"][:, H:], kept["a"][:, 2 * H :]
        stay = 1 - z
        by_n, by_z, by_r = z * (1 - n * n), (n - h0) * z * stay, a * r * (1 - r)
        d, dn = np.empty((steps, 3 * H, streams), hs.dtype), np.empty_like(n)  # of the gates, and of what r lets through
        u1, u2, new = np.ascontiguousarray(p["u"][:, : 2 * H]), np.ascontiguousarray(p["u"][:, 2 * H :]), fresh.any(1)
        dh = np.zeros((H, streams), hs.dtype)
        for t in range(steps - 1, -1, -1):
            dh += dhs[t]
            np.multiply(dh, by_z[t], out=d[t, :H])
            np.multiply(dh, by_n[t], out=d[t, 2 * H :])
            np.multiply(d[t, 2 * H :], by_r[t], out=d[t, H : 2 * H])
            np.multiply(d[t, 2 * H :], r[t], out=dn[t])
            dh *= stay[t]
            dh += u1 @ d[t, : 2 * H]
            dh += u2 @ dn[t]
            if new[t]:
                dh[:, fresh[t]] = 0
        g["u"][:, : 2 * H] = np.matmul(h0, d[:, : 2 * H].transpose(0, 2, 1)).sum(0)
        g["u"][:, 2 * H :] = np.matmul(h0, dn.transpose(0, 2, 1)).sum(0)
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        spots, starts = np.unique(ids[order], return_index=True)
        rows = np.zeros((self.n, 3 * H), hs.dtype)
        rows[spots] = np.add.reduceat(d.transpose(0, 2, 1).reshape(-1, 3 * H)[order], starts, axis=0)
        rows.sum(0, out=g["b"])
        np.matmul(p["emb"].T, rows, out=g["w"])
        np.matmul(rows, p["w"].T, out=g["emb"])
        return h

    def train(self, y: np.ndarray, sums: np.ndarray) -> None:
        """One pass over laid-out streams; sums: Adagrad's sums of squares, kept by the caller."""
        h, g = np.zeros((self.hidden, y.shape[1]), self.flat.dtype), np.empty_like(self.flat)
        for _, x, fresh, yy, live in self.windows(y, STEPS):
            h = self.gradients(x, fresh, yy, live, h[:, : x.shape[1]], g)
            g /= g.dtype.type(max(1, live.sum()) ** 0.5)
            sums += g * g
            g *= RATE
            g /= np.sqrt(sums)
            self.flat -= g

    def score(self, docs: list[np.ndarray], window: int = 64) -> np.ndarray:
        """The natural log probability of each document's symbols, the state carried through all of it."""
        y, at = lay_out(docs, STREAMS)
        h, logp = np.zeros((self.hidden, y.shape[1]), self.flat.dtype), np.zeros(y.shape, np.float32)
        for t, x, fresh, yy, live in self.windows(y, window):
            hs, h = self.states(x, fresh, h[:, : x.shape[1]])
            part = np.zeros(yy.size, np.float32)
            part[live] = self.log_probs(hs.transpose(0, 2, 1).reshape(-1, self.hidden)[live], yy.ravel()[live])[0]
            logp[t : t + len(x), : x.shape[1]] = part.reshape(x.shape)
        return np.array([logp[t : t + len(d), s].sum(dtype=np.float64) for d, (s, t) in zip(docs, at)])


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) over rows' texts, A-Z in lower case; each task hands on a word once per few megabytes."""

    def count(batches):
        for batch in merged(batches, "text"):
            _, code, words = word_codes(batch["text"])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, minlength=len(words)), pa.int64())], names=["word", "c"])

    return rows.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """Words and counts, by falling count and then by word, from the count down to which there are at most `most` words: the driver gets no other words.

    Counts are told apart to a thirty-second of an octave, so that the histogram of counts has some 2,000 rows at any size.
    """
    octave = F.floor(F.log2("c") * 32)
    sizes = sorted(((r.o, r.n) for r in counts.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for o, n in sizes:
        held += n
        if held > most:
            break
        least = o
    return counts.where(octave >= least if least is not None else F.lit(False)).toArrow().sort_by([("c", "descending"), ("word", "ascending")])


def _added(batches):
    """One row: the sums of tokens and of p."""
    tokens, total = 0, None
    for batch in batches:
        for n, p in zip(batch["tokens"].to_pylist(), batch["p"]):
            own = p.values.to_numpy()
            tokens, total = tokens + n, own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens], pa.int64()), "p": pa.array([total], pa.list_(pa.float64()))})


def fit(train: DataFrame, net: Net) -> Net:
    """Trains on rows (symbols, part), part 0..15, round by round. The driver holds the parameters: under 100,000 numbers."""
    spark = train.sparkSession
    schema = "tokens long, p array<double>"
    few = max(1, isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for parts in ROUNDS:
        shared = spark.sparkContext.broadcast(net)

        def run(batches, shared=shared):
            own = shared.value.copy()
            sums, total = np.full_like(own.flat, 1e-2), 0
            for docs in grouped(batches):
                own.train(lay_out(docs, STREAMS)[0], sums)
                total += sum(map(len, docs))
            if total:
                yield pa.RecordBatch.from_pydict({"tokens": pa.array([total], pa.int64()), "p": pa.array([own.flat.astype(np.float64) * total], pa.list_(pa.float64()))})

        made = train.where(F.col("part").isin(list(parts))).select("symbols").mapInArrow(run, schema)
        got = made.repartition(few).mapInArrow(_added, schema).repartition(1).mapInArrow(_added, schema).first()  # a tree, so that no task meets all
        if got:
            net = net.copy().load((np.array(got.p) / got.tokens).astype(np.float32))
        shared.unpersist()
    return net


def grouped(batches):
    """Lists of documents' symbols, of about GROUP tokens each."""
    docs, held = [], 0
    for batch in batches:
        for x in batch["symbols"]:
            docs.append(np.frombuffer(x.as_buffer(), "<i2"))
            held += len(docs[-1])
            if held > GROUP:
                yield docs
                docs, held = [], 0
    if docs:
        yield docs


class Counts:
    """What scoring and encoding need of the counts: sizes, the TOP words with theirs, and the alphabet by falling frequency."""

    def __init__(self, counts: DataFrame, n_docs: int):
        distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        self.n_docs, self.V, self.N = n_docs, distinct + (n_docs > 0), total + n_docs
        top = most_frequent(counts, TOP)
        self.words, c = pa.concat_arrays([pa.array([], pa.binary()), *(x.cast(pa.binary()) for x in top["word"].chunks)]), top["c"].to_numpy().astype(np.float64)
        self.logs, self.frequent = np.log10(c + 0.5), min(VOCAB, len(c))
        rest = counts
        if self.frequent:
            least, word = int(c[self.frequent - 1]), self.words[self.frequent - 1].as_py()
            rest = counts.where((F.col("c") < least) | ((F.col("c") == least) & (F.col("word") > F.lit(word))))
        tail = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS))
        tails = {r.t: (r.c, r.n) for r in rest.groupBy(tail.alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
        tail_c, tail_n = (np.array([tails.get(t, (0, 0))[k] for t in range(TAILS)], np.float64) for k in (0, 1))
        self.log_tail = np.log10(tail_c + 0.5 * (tail_n + 1))
        freq = np.concatenate([[n_docs], c[: self.frequent], tail_c])
        order = np.argsort(-freq, kind="stable")
        self.freq, self.rank = freq[order], np.argsort(order).astype(np.int16)  # raw: the end, frequent words, tails
        self.base = float(np.log10(self.N + 0.5 * (self.V + 1)))
        self.end_log = float(np.log10(n_docs + 0.5))

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: symbol, whether among the TOP, its log smoothed count or 0, and its weight inside its tail or 0."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        seen = at >= 0
        logs = np.where(seen, self.logs[np.where(seen, at, 0)] if len(self.logs) else 0.0, 0.0)
        ends = pc.binary_slice(words, -2).dictionary_encode()
        own = np.array([zlib.crc32(x) % TAILS for x in ends.dictionary.to_pylist()], np.int64)
        tail = own[ends.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        inside = seen & (at < self.frequent)
        symbol = self.rank[np.where(inside, at + 1, 1 + self.frequent + tail)]
        return symbol, seen, logs, np.where(inside, 0.0, logs - self.log_tail[tail])


_ENCODED = "row long, doc_id long, key binary, train boolean, part int, symbols binary, n_tokens long, known long, base double, inner double, rare array<struct<word:binary,n:int>>"


def encoded(rows: DataFrame, counts: Counts) -> DataFrame:
    """From rows (doc_id, key, text, train, part): each with a number of its own, its symbols, what the TOP words give, and the other words."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)  # TOP words at most

    def encode(batches):
        know, next_row = shared.value, TaskContext.get().partitionId() << 40
        for batch in merged(batches, "text"):
            n = batch.num_rows
            own, code, words = word_codes(batch["text"])
            symbol, seen, logs, inner = know.of(words)
            sizes = np.bincount(own, minlength=n)
            ends = np.cumsum(sizes + 1)
            flat = np.full(int(ends[-1]), know.rank[0], "<i2")
            flat[np.arange(len(code)) + own] = symbol[code]
            symbols = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]) * 2), pa.py_buffer(flat)]).cast(pa.binary())
            summed = lambda x: np.bincount(own, x[code], minlength=n).astype(np.float64)  # noqa: E731, B023; whole numbers where there are no words
            rare, times = np.unique(own[~seen[code]] * max(1, len(words)) + code[~seen[code]], return_counts=True)
            cuts = np.searchsorted(rare // max(1, len(words)), np.arange(n + 1)).astype(np.int32)
            others = pa.StructArray.from_arrays([words.take(pa.array(rare % max(1, len(words)))), pa.array(times, pa.int32())], ["word", "n"])
            known = summed(seen).astype(np.int64) + int(know.n_docs > 0)
            base = summed(logs) + know.end_log - (sizes + 1) * know.base
            cols = [pa.array(np.arange(next_row, next_row + n)), batch["doc_id"], batch["key"], batch["train"], batch["part"], symbols, pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(summed(inner)), pa.ListArray.from_arrays(pa.array(cuts), others)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "key", "train", "part", "symbols", "n_tokens", "known", "base", "inner", "rare"])
            next_row += n

    return rows.select("doc_id", "key", "text", "train", "part").mapInArrow(encode, _ENCODED)


def in_fold() -> Column:
    """Whether a row is held out; rows without an id never are."""
    return F.coalesce(fold() == FOLD, F.lit(False))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row, learned from the rows outside fold FOLD."""
    rows = texts(docs, id_col, text_col).withColumns({"train": ~in_fold(), "key": F.unhex(F.md5("text"))})
    train = rows.where("train")
    counts = written(count_words(train), "lm-counts")
    know = Counts(counts, train.count())
    part = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(16)).cast("int")
    told = written(encoded(rows.withColumn("part", part), know), "lm-symbols")
    net = fit(told.where("train").select("symbols", "part"), Net(know.freq, int(know.rank[0])))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    own = ["row", "doc_id", "key", "n_tokens", "known", "base", "inner"]

    def score(batches):
        rows_, places, at, held = [], [], {}, 0  # at: each distinct text's symbols and their place

        def flush():
            logs = shared.value.score([np.frombuffer(x, "<i2") for x in at]) / np.log(10)
            return pa.RecordBatch.from_arrays([*pa.Table.from_batches(rows_).combine_chunks().to_batches()[0].columns, pa.array(logs[places])], names=[*own, "net"])

        for batch in batches:
            rows_.append(batch.select(own))
            for x in batch["symbols"].to_pylist():
                if x not in at:
                    held += len(x) // 2
                places.append(at.setdefault(x, len(at)))
            if held > GROUP:
                yield flush()
                rows_, places, at, held = [], [], {}, 0
        if places:
            yield flush()

    scored = told.drop("train", "part", "rare").mapInArrow(score, "row long, doc_id long, key binary, n_tokens long, known long, base double, inner double, net double")
    n, c = F.col("n"), F.col("c")
    found = told.select("row", F.inline("rare")).join(counts, "word", "left")
    sums = found.groupBy(F.col("row").alias("s_row")).agg(F.sum(n * F.log10(F.coalesce(c, F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(c.isNotNull(), n)).alias("more"))
    both = scored.join(sums, F.col("row") == F.col("s_row"), "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    both = written(both.select("doc_id", "key", "n_tokens", (F.col("known") + more).alias("n_known"), (F.col("base") + logs).alias("base"), (F.col("net") + F.col("inner") + logs).alias("all")), "lm-scores")
    alike = written(both.groupBy(F.col("key").alias("text_key")).agg(F.min("base").alias("base_score"), F.min("all").alias("score")), "lm-texts")  # so that Spark can split the rows of one text
    return both.join(alike, F.col("key") == F.col("text_key")).select("doc_id", "n_tokens", "n_known", F.lit(know.N).cast("long").alias("train_tokens"), "base_score", "score")


def op10_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    out = score_texts(read_documents(spark, sf_dir))
    return out.select("doc_id", in_fold().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
