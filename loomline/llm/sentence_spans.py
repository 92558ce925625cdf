"""Substring dedup by sliding spans of sentences.

A text is cut into sentences, and sentences of over MAX_WORDS words into pieces, so that a long one is several. A
piece begins where the hash of a word and the one before it is the least within NEAR words, so that a passage
falls into the same pieces wherever in a sentence it stands; no piece has over LONGEST words. From every sentence on, and back from every sentence, the shortest span of SPAN sentences
and MIN_WORDS words at least is hashed (XXH3, 128 bits, of its words). A span's first place is the least
(doc_id, sentence) among all texts; sentences that a span covers anywhere else are removed.

A sentence ends after . ! or ? with white space behind, or at a newline; spans compare words (cut at ASCII white
space) alone, not the white space between. Null and empty texts have no sentences. Null ids come before all others. Rows with equal
id and text are one document: neither repeats the other. Empty tables give no rows.
Spans are counted before they are dealt, the repeated ones with their first places are written, and all spans are
joined to them by their hash: a span that very many texts share is a hot join key, whose side Spark splits, and not a
group. Texts are cut and hashed twice, once to count and once to join: keeping all spans instead would take
more of the disk than the second pass takes of the time.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect, bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import lean_batches, read_documents, row_key
from loomline.session import written

SPAN, MIN_WORDS, MAX_WORDS, NEAR, LONGEST = 3, 20, 20, 4, 40


def borders(words: list[bytes]) -> np.ndarray:
    """Whether a piece may begin at each word."""
    n = len(words)
    one = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    h = np.full(n + 2 * NEAR, 2**63, np.uint64)
    h[NEAR + 1 : NEAR + n] = (one[1:] * np.uint64(0x9E3779B1) ^ one[:-1] * np.uint64(0x85EBCA77)) & np.uint64(2**62 - 1)
    mine, least = h[NEAR : NEAR + n], np.ones(n, bool)
    for k in range(2 * NEAR + 1):
        if k != NEAR:
            least &= h[k : k + n] > mine  # ties have no least
    return least


def sentences(raw: bytes) -> tuple[list[int], list[int], bytes, list[int]]:
    """Where each sentence or piece starts in raw; where it starts in the words joined by one space; those; and how many words each has.

    Each reaches to the next one's start.
    """
    words, places, begins, at = [], [], [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            begins.append(len(words))
            sizes = list(map(len, own))
            if sum(sizes) + len(own) - 1 == len(line.strip()):
                lead = at + len(line) - len(line.lstrip())
                places += [lead + k + n for k, n in enumerate(accumulate(sizes[:-1], initial=0))]
            else:
                places += [at + m.start() for m in re.finditer(rb"\S+", line)]
            words += own
        at += len(line) + 1
    n = len(words)
    if not n:
        return [], [], b"", []
    begins = sorted({*begins, *[k + 1 for k, w in enumerate(words[:-1]) if w[-1] in b".!?"]})
    if any(b - a > MAX_WORDS for a, b in zip(begins, [*begins[1:], n])):
        may, out = np.flatnonzero(borders(words)).tolist(), []
        for a, b in zip(begins, [*begins[1:], n]):
            out.append(a)
            if b - a > MAX_WORDS:
                for k in [*may[bisect(may, a) : bisect_left(may, b)], b]:
                    while k - out[-1] > LONGEST:
                        out.append(out[-1] + LONGEST)
                    if k < b:
                        out.append(k)
        begins = out
    joined = [k + m for k, m in enumerate(accumulate(map(len, words), initial=0))]
    return [places[k] for k in begins], [joined[k] for k in begins], b" ".join(words), [b - a for a, b in zip(begins, [*begins[1:], n])]


def spans(counts: list[int]) -> list[tuple[int, int]]:
    """The shortest spans (from, to) that reach SPAN sentences and MIN_WORDS words, forward from and back from each sentence."""
    n = len(counts)
    sums = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    at = np.arange(n)
    to = np.maximum(at + SPAN, np.searchsorted(sums, sums[:-1] + MIN_WORDS))
    ends = at + 1
    back = np.minimum(ends - SPAN, np.searchsorted(sums, sums[1:] - MIN_WORDS, side="right") - 1)
    code = np.unique(np.concatenate([(at * (n + 1) + to)[to <= n], (back * (n + 1) + ends)[back >= 0]]))
    return list(zip((code // (n + 1)).tolist(), (code % (n + 1)).tolist())) if len(code) else []


def _hashed(batches):
    """Rows (id, tkey, ab, at, h1, h2): a span's sentences a..b - 1 and its bytes, both packed, and its digest."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            who, places, at, codes = [], [], [], []
            for i, text in enumerate(some["text"].to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                starts, cuts, line, counts = sentences(raw)
                own = spans(counts)
                if own:
                    ends, to = [*starts[1:], len(raw)], [*cuts, len(line) + 1]
                    codes += [xxhash.xxh3_128_digest(line[cuts[a] : to[b] - 1]) for a, b in own]
                    who += [i] * len(own)
                    places += [a << 32 | b for a, b in own]
                    at += [starts[a] << 32 | ends[b - 1] for a, b in own]
            if who:
                pick = pa.array(who)
                h = np.frombuffer(b"".join(codes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([some["id"].take(pick), some["tkey"].take(pick), pa.array(places, pa.int64()), pa.array(at, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["id", "tkey", "ab", "at", "h1", "h2"])


def repeated_sentences(rows: DataFrame) -> DataFrame:
    """From rows (id, tkey, text): rows (id, tkey, ab, at), spans whose first place is elsewhere: sentences a..b - 1, and bytes from..to - 1."""
    found = rows.mapInArrow(_hashed, "id long, tkey long, ab long, at long, h1 long, h2 long")
    place = F.struct("id", "tkey", F.shiftright("ab", 32).alias("a"))
    firsts = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    firsts = written(firsts, "span-firsts")  # a plain table, so that the join can be split
    later = found.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("id", "tkey", "ab", "at")


_OUT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("kept", T.StringType())])


@F.arrow_udf(_OUT)
def _cut(text: pa.Array, gone: pa.Array) -> pa.Array:
    rows = []
    for x, spans_ in zip(text.to_pylist(), gone.to_pylist()):
        drop = sorted({k for s in spans_ or () for k in range(s["ab"] >> 32, s["ab"] & 0xFFFFFFFF)})
        raw, parts, at = x.encode("utf-8", "surrogatepass"), [], 0
        for start, end in sorted((s["at"] >> 32, s["at"] & 0xFFFFFFFF) for s in spans_ or ()):
            parts.append(raw[at:start])  # empty where spans overlap
            at = max(at, end)
        rows.append((len(drop), drop, b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")))
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.string()))], ["n_removed", "removed", "kept"])


def remove_repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a struct column `repeats`: n_removed, removed (the sentences' numbers) and kept, the text without them."""
    packed = lean_batches(docs).select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("tkey", row_key())
    gone = repeated_sentences(packed.select("id", "tkey", "text")).groupBy("id", "tkey").agg(F.collect_set(F.struct("ab", "at")).alias("gone"))
    gone = gone.withColumnsRenamed({"id": "g_id", "tkey": "g_tkey"})
    joined = packed.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("tkey") == F.col("g_tkey")), "left")
    return joined.select("row", _cut("text", "gone").alias("repeats"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, removed and kept_sha256 of every document."""
    out = remove_repeated_sentences(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "repeats.n_removed", "repeats.removed", F.sha2(F.col("repeats.kept").cast("binary"), 256).alias("kept_sha256"))
