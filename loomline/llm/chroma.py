"""Chroma audio fingerprints of a media column, and their alignment.

A recording is 16-bit little-endian mono samples in a binary column. Its spectrum, frame by frame, is folded
into twelve pitch classes; filters over the integral image of those frames compare sums of rectangles, and each
filter's value becomes two bits (Gray-coded quarters), sixteen filters one packed 32-bit integer per frame.
Two recordings align where a histogram of offsets between equal integers peaks and the bit error over the overlap is low.

Null audio, and audio of under WINDOW frames, has no integers and aligns with nothing. Recordings with
equal integers are one class, compared once; a null id belongs to its class but does not name it. Searches take a
stated set of queries, in blocks of BLOCK classes, against all classes; every block is broadcast, so
what is broadcast is bounded, and nothing is left out. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import lean_batches
from loomline.session import table, written

RATE, FRAME, HOP, WINDOW = 8000, 2048, 512, 16
LOW, HIGH = 100.0, 2000.0
#: Equal integers at one offset that make it a candidate; least overlap in integers; most differing bits in a hundred.
HITS, OVERLAP, BIT_ERROR_PERCENT = 3, 16, 20
BLOCK = 2000


def _folding() -> np.ndarray:
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    inside = np.flatnonzero((hz >= LOW) & (hz <= HIGH))
    fold = np.zeros((len(hz), 12), np.float32)
    fold[inside, np.round(12 * np.log2(hz[inside] / 440)).astype(int) % 12] = 1
    return fold


_FOLD, _HANN = _folding(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of twelve pitch classes, each of length 1 unless silent."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    if not n:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP][:n] * _HANN
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2 @ _FOLD
    size = np.sqrt((power**2).sum(1, keepdims=True))
    return power / np.where(size > 1e-3, size, np.inf)


def _bank() -> list[tuple[list, list]]:
    """Sixteen filters by rule: for each of four spans of pitch classes and each of four shapes, the rectangles added and taken away."""
    bank = []
    for low, high, wide in ((0, 12, 16), (0, 6, 8), (6, 12, 8), (3, 9, 12)):
        mid, half, third = (low + high) // 2, wide // 2, (high - low) // 3
        bank += [
            ([(0, half, low, high)], [(half, wide, low, high)]),
            ([(0, wide, low, mid)], [(0, wide, mid, high)]),
            ([(0, half, low, mid), (half, wide, mid, high)], [(0, half, mid, high), (half, wide, low, mid)]),
            ([(0, wide, low + third, high - third)], [(0, wide, low, low + third), (0, wide, high - third, high)]),
        ]
    return bank


_BANK, _GRAY = _bank(), np.array([0, 1, 3, 2], np.uint32)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """A packed integer per frame that WINDOW frames follow from."""
    frames = chroma(samples)
    n = len(frames) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at, out = np.arange(n), np.zeros(n, np.uint32)
    area = lambda r: image[at + r[1], r[3]] - image[at + r[0], r[3]] - image[at + r[1], r[2]] + image[at + r[0], r[2]]
    for plus, minus in _BANK:
        value = np.log1p(sum(map(area, plus))) - np.log1p(sum(map(area, minus)))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted((-0.25, 0.0, 0.25), np.round(value, 6), side="right")]
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _fingerprints(audio: pa.Array) -> pa.Array:
    return pa.array([fingerprint(np.frombuffer(x or b"", "<i2", len(x or b"") // 2)).view(np.int32) for x in audio.to_pylist()], pa.list_(pa.int32()))


def fingerprint_of(audio: Column) -> Column:
    return _fingerprints(audio)


@F.arrow_udf(T.BinaryType())
def _melody(vector: pa.Array) -> pa.Array:
    t = np.arange(HOP) / RATE
    out = []
    for x in vector.to_pylist():
        v = np.nan_to_num(np.array([0.0 if y is None else y for y in x or ()], np.float64))
        tones = np.round(24 * v / max(np.abs(v).max(initial=0), 1e-9)) if len(v) else v
        wave = np.sin(2 * np.pi * (440 * 2 ** (tones[:, None] / 12)) * t).ravel()
        out.append((wave * 12_000).astype("<i2").tobytes())
    return pa.array(out, pa.binary())


def melody_of(vector: Column) -> Column:
    """A recording of a vector: a note of HOP samples per number, by semitones around 440 Hz."""
    return _melody(vector)


class Block:
    """Queries (class id, integers) as one sorted list of integers with their places."""

    def __init__(self, queries: list[tuple[int, list[int]]]):
        self.ids = np.array([i for i, _ in queries], np.int64)
        self.codes = [np.asarray(c, np.int32).view(np.uint32) for _, c in queries]
        flat = np.concatenate([np.zeros(0, np.uint32), *self.codes])
        order = np.argsort(flat, kind="stable")
        self.flat = flat[order]
        self.who = np.repeat(np.arange(len(queries)), [len(c) for c in self.codes])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in self.codes]])[order]

    def align(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(query id, offset, differing bits, bits compared) of every query that aligns; offset is where the query starts."""
        lo, hi = np.searchsorted(self.flat, codes, "left"), np.searchsorted(self.flat, codes, "right")
        n = hi - lo
        if not n.sum():
            return []
        spots = np.repeat(lo - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        offset = np.repeat(np.arange(len(codes)), n) - self.place[spots]
        pairs, hits = np.unique(np.stack([self.who[spots], offset], 1), axis=0, return_counts=True)
        best: dict[int, tuple] = {}
        for (q, o), h in zip(pairs[hits >= HITS].tolist(), hits[hits >= HITS].tolist()):
            own = self.codes[q]
            a, b = max(0, o), min(len(codes), o + len(own))
            if b - a >= OVERLAP:
                errors = int(np.bitwise_count(codes[a:b] ^ own[a - o : b - o]).sum())
                if 100 * errors <= BIT_ERROR_PERCENT * 32 * (b - a):
                    best[q] = min(best.get(q, (2, 0, 0, 0)), (errors / (32 * (b - a)), o, errors, 32 * (b - a)))
        return [(int(self.ids[q]), *x[1:]) for q, x in sorted(best.items())]


def search(prints: DataFrame, queries: Column) -> DataFrame:
    """From rows (id, codes): one row per row with class_id, n_codes, n_aligned (classes of queries that align) and the best of them, with its offset and bit errors.

    queries tells which rows are queries, by id. Best is the least bit error rate, then the least query id.
    """
    spark = lean_batches(prints).sparkSession  # audio is large, so few rows at once
    keyed = written(prints.select("id", "codes", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit(1), F.col("codes")).alias("h2")), "prints")
    named = F.coalesce("id", F.lit(2**63 - 1))
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.min(F.when(queries, F.col("id"))).alias("query"), F.min_by("codes", named).alias("codes"))
    classes = written(classes, "print-classes")
    asked = classes.where(F.col("query").isNotNull() & (F.size("codes") > 0))
    numbers = numbered(asked.select("query", "h1", "h2")).select("h1", "h2", F.floor(F.col("k") / BLOCK).alias("block"))
    asked = written(asked.join(numbers, ["h1", "h2"]).select("query", "codes", "block"), "print-queries")
    found = None
    for b in range(-(-asked.count() // BLOCK)):
        own = [(r["query"], r.codes) for r in asked.where(F.col("block") == b).collect()]  # BLOCK rows at most
        shared = spark.sparkContext.broadcast(Block(own))

        def run(batches, shared=shared):
            for batch in batches:
                rows = []
                for h1, h2, codes in zip(*(batch[c].to_pylist() for c in ("h1", "h2", "codes"))):
                    got = shared.value.align(np.asarray(codes, np.int32).view(np.uint32))
                    if got:
                        q = min(got, key=lambda x: (x[2] / x[3], x[0]))
                        rows.append((h1, h2, len(got), *q))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["h1", "h2", "n", "query", "offset", "errors", "bits"])

        part = classes.select("h1", "h2", "codes").mapInArrow(run, "h1 long, h2 long, n long, query long, offset long, errors long, bits long")
        found = part if found is None else found.unionByName(part)
    out = classes.select("h1", "h2", "class_id")
    if found is None:
        out = out.selectExpr("*", "0L as n_aligned", "null as best")
        best_type = "struct<rate:double,query:long,offset:long,errors:long,bits:long>"
        out = out.withColumn("best", F.col("best").cast(best_type))
    else:
        best = F.min(F.struct((F.col("errors") / F.col("bits")).alias("rate"), "query", "offset", "errors", "bits"))
        out = out.join(found.groupBy("h1", "h2").agg(F.sum("n").alias("n_aligned"), best.alias("best")), ["h1", "h2"], "left")
    rows = keyed.select("id", "h1", "h2", F.size("codes").alias("n_codes")).join(out, ["h1", "h2"])
    return rows.select("id", "n_codes", "class_id", F.coalesce("n_aligned", F.lit(0)).alias("n_aligned"), F.col("best.query").alias("best_query"), F.col("best.offset").alias("best_offset"), F.col("best.errors").alias("bit_errors"), F.col("best.bits").alias("bits"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with their place k, from 0, by all columns: counts of range partitions, a prefix sum, and places within each."""
    own = rows.columns
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *own).withColumn("part", F.spark_partition_id()), "print-numbers")
    counts = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per partition
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "part int, start long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*own))
    return dealt.withColumn("place", within).join(F.broadcast(starts), "part").select(*own, (F.col("start") + F.col("place") - 1).alias("k"))


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a recording, its fingerprint's class, and how the queries (ids divisible by 100) align with it."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), fingerprint_of(melody_of(F.col("embedding"))).alias("codes"))
    return search(rows, F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")
