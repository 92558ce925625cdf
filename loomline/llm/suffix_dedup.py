"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts elsewhere.

A string of `length` bytes is a window, LENGTH unless a caller sets another. The least GRAM-byte string in a window, by hash and then the leftmost,
is its anchor, so equal windows have equal anchors at equal places, and windows meet by what they hold:

1. Neighbouring windows with one anchor form a run. A run whose bytes are another run's consists of repeats.
2. Runs that share their anchor's bytes but differ elsewhere are cut, at fixed distances from the anchor,
   into cells of CELL windows. All windows of a cell share its core; what is around it, CELL - 1 bytes on
   each side, makes a short string in which the core is one symbol.
3. Cells with one core go to one task, which concatenates their strings and builds the suffix array
   (linear grouping construction). Windows are repeated where neighbours in it agree for a window's length.

A core with very many different surroundings is dealt over several tasks, each of which compares its own;
windows of such cores are then also counted across tasks, by their bytes. Equal runs and equal cells are
counted before they are dealt, so many copies of a text cost as much as two.

Texts are UTF-8 bytes, whole, and a null text is empty. Matches never cross documents, and repeated rows
are documents of their own: each repeats the other. Texts under `length` bytes hold no window. Ids may be
null or shared. Empty tables give no rows. Runs are compared by two 64-bit digests, of the anchor and of the whole,
and cores by a 128-bit one (XXH3). Intermediate tables are deleted when the spans are written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import lean_batches, read_documents, row_key
from loomline.llm.suffix_sort import suffix_array
from loomline.session import Scratch, written

LENGTH, GRAM, CELL = 400, 24, 32
SIDE = CELL - 1
#: Bytes of the shorter strings that the query counts beside those it removes: under what 50 words of short words take.
PASSAGE = 256
#: Bytes that one pass over a batch of texts takes; longer texts are taken in pieces, whose windows do not overlap.
PIECE = 1 << 20
#: Different surroundings of a core that one task takes, and cells of a task.
PER_CORE, PER_TASK = 1000, 3000
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_LIFT, _DROP = (_powers(b, 2 * PIECE) for b in (_ODD, pow(_ODD, -1, 2**64)))


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For each window start, the position of its anchor."""
    n, width = len(data), length - GRAM + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _DROP[:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _LIFT[: n - GRAM + 1] * np.uint64(_ODD)
    # the position in the low bits makes the leftmost of equal grams the least
    least = (grams & ~np.uint64(2**31 - 1)) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(least) % width
    tiles = np.concatenate([least, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(tiles, axis=1).ravel()
    right = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    return (np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & np.uint64(2**31 - 1)).astype(np.int64)


def _digest(x: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(x)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _runs(length: int):
    """Rows (id, tkey, at, gram, code): a run of windows by its anchor p and how far before it they start, packed into at, all in bytes of the text."""

    def flush(some):
        data = np.frombuffer(b"".join(x for _, _, x in some), np.uint8)
        ends = np.cumsum([len(x) for _, _, x in some])
        starts = ends - [len(x) for _, _, x in some]
        if len(data) < length:
            return None
        anchor = _anchors(data, length)
        own = np.repeat(np.arange(len(some)), [max(0, len(x) - length + 1) for _, _, x in some])
        at = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(starts, ends)]) if len(own) else own
        if not len(at):
            return None
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor[at]) != 0) | (np.diff(own) != 0)]))
        lo, hi, who, p = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], own[new], anchor[at[new]]
        raw = data.tobytes()
        code = np.array([xxhash.xxh3_64_intdigest(raw[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64).view(np.int64)
        gram = np.array([xxhash.xxh3_64_intdigest(raw[x : x + GRAM]) for x in p.tolist()], np.uint64).view(np.int64)
        from_start = np.array([k for _, k, _ in some])[who] - starts[who]
        ids, keys = zip(*(i for i, _, _ in some))
        pick = pa.array(who)
        packed = ((p + from_start) << 32) | ((p - lo) << 16) | (p - hi)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pick), pa.array(keys, pa.int64()).take(pick), pa.array(packed), pa.array(gram), pa.array(code)], names=["id", "tkey", "at", "gram", "code"])

    def run(batches):
        some, held = [], 0
        for batch in batches:
            for i, key, text in zip(*(batch[c].to_pylist() for c in ("id", "tkey", "text"))):
                raw = text.encode("utf-8", "surrogatepass")
                for k in range(0, max(1, len(raw) - length + 1), PIECE // 2):
                    piece = raw[k : k + PIECE // 2 + length - 1]
                    if held + len(piece) > PIECE and some:
                        if (out := flush(some)) is not None:
                            yield out
                        some, held = [], 0
                    if len(piece) >= length:
                        some.append(((i, key), k, piece))
                        held += len(piece)
        if some and (out := flush(some)) is not None:
            yield out

    return run


def _cells(length: int):
    """Rows (id, tkey, base, c1, c2, around, first, last): cell of the windows base..base + CELL - 1, of which first..last lie in the text."""

    def run(batches):
        for batch in batches:
            out = []
            for i, key, text, runs in zip(*(batch[c].to_pylist() for c in ("id", "tkey", "text", "runs"))):
                raw, seen = text.encode("utf-8", "surrogatepass"), set()
                for at in runs:
                    p = at >> 32
                    for c in range((at & 0xFFFF) // CELL, (at >> 16 & 0xFFFF) // CELL + 1):
                        base = p - c * CELL - SIDE
                        if base not in seen:
                            seen.add(base)
                            core = _digest(raw[base + SIDE : base + length])
                            left, right = raw[max(0, base) : base + SIDE], raw[base + length : base + length + SIDE]
                            around = left.rjust(SIDE, b"\0") + right.ljust(SIDE, b"\0")
                            out.append((i, key, base, *core, around, max(0, -base), min(SIDE, len(raw) - length - base)))
                if len(out) > 20_000:
                    yield _cell_batch(out)
                    out = []
            if out:
                yield _cell_batch(out)

    return run


_CELL_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
_CELL_NAMES = ["id", "tkey", "base", "c1", "c2", "around", "first", "last"]


def _cell_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _CELL_TYPES)], names=_CELL_NAMES)


def repeated_windows(cores: np.ndarray, around: list[bytes], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For cells (their core's number and the bytes around it): a mask of the windows that another of these cells holds too, by a suffix array."""
    m, width = len(around), 2 * SIDE + 1
    sides = np.frombuffer(b"".join(around), np.uint8).reshape(m, 2 * SIDE).astype(np.int64)
    text = np.concatenate([sides[:, :SIDE], 256 + cores[:, None], sides[:, SIDE:]], axis=1).ravel()
    order = suffix_array(text)
    cell, offset = order // width, order % width
    ok = (offset < CELL) & (offset >= first[cell]) & (offset <= last[cell])
    order, cell, offset = order[ok], cell[ok], offset[ok]
    # equal windows are neighbours among the windows that hold a core, as those are in the order of all suffixes
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(CELL):
        same &= text[order[1:] + k] == text[order[:-1] + k]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    mask = np.zeros(m, np.int64)
    np.bitwise_or.at(mask, cell[again], np.int64(1) << offset[again])
    return mask


def _sorted_cells(rows: pd.DataFrame) -> pd.DataFrame:
    cores = rows.groupby(["c1", "c2"], sort=False).ngroup().to_numpy(np.int64)
    rows["mask"] = repeated_windows(cores, list(rows["around"]), rows["first"].to_numpy(np.int64), rows["last"].to_numpy(np.int64))
    return rows[["c1", "c2", "around", "first", "last", "d", "mask"]]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """From rows (id, text, tkey): rows (id, tkey, lo, hi, mask), with windows lo..hi, or lo + k for each bit k of mask, that also start elsewhere."""
    with Scratch(docs.sparkSession) as held:
        return written(_spans(docs, length, held), "repeated-spans")


def _spans(docs: DataFrame, length: int, held: Scratch) -> DataFrame:
    if not GRAM + CELL <= length < 1 << 16:
        raise ValueError(f"a length of {GRAM + CELL} to 65535 bytes, not {length}")
    long = docs.where(F.octet_length("text") >= length).select("id", "tkey", "text")
    runs = held.written(long.mapInArrow(_runs(length), "id long, tkey long, at long, gram long, code long"), "runs")
    kinds = runs.groupBy("gram", "code").agg(F.count("*").alias("n"), F.min(F.struct("id", "tkey", "at")).alias("r"))
    kinds = held.written(kinds, "run-kinds")
    whole = kinds.where("n > 1").select("gram", "code")
    p = F.shiftright("at", 32)
    lo, hi = (p - F.shiftright("at", k).bitwiseAND(F.lit(0xFFFF)) for k in (16, 0))
    twins = runs.join(whole, ["gram", "code"]).select("id", "tkey", lo.alias("lo"), hi.alias("hi"), F.lit(None).cast("long").alias("mask"))

    shared = kinds.groupBy("gram").agg(F.count("*").alias("d")).where("d > 1").select("gram")
    work = kinds.join(shared, "gram").select("r.*").groupBy("id", "tkey").agg(F.collect_list("at").alias("runs"))
    key = [F.col("id").eqNullSafe(F.col("w_id")), F.col("tkey") == F.col("w_tkey")]
    with_text = lean_batches(docs).select("id", "tkey", "text").join(work.withColumnsRenamed({"id": "w_id", "tkey": "w_tkey"}), key).select("id", "tkey", "text", "runs")
    cell_schema = "id long, tkey long, base long, c1 long, c2 long, around binary, first int, last int"
    cells = held.written(with_text.mapInArrow(_cells(length), cell_schema), "cells")

    alike = ["c1", "c2", "around", "first", "last"]
    items = cells.groupBy(*alike).agg(F.count("*").alias("n"))
    cores = items.groupBy("c1", "c2").agg(F.count("*").alias("d"), F.sum("n").alias("all")).where(F.col("all") > 1)
    items = held.written(items.join(cores.select("c1", "c2", "d"), ["c1", "c2"]), "cell-kinds")
    every = sum((F.when((F.col("first") <= k) & (F.col("last") >= k), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(CELL)), F.lit(0).cast("long"))
    full = items.where("n > 1").select(*alike, every.alias("mask"))
    many = items.where("d > 1")
    tasks = max(1, many.count() // PER_TASK)
    salt = F.pmod(F.xxhash64("around"), F.ceil(F.col("d") / PER_CORE))
    bucket = F.pmod(F.xxhash64("c1", "c2", salt), F.lit(tasks))
    dealt = many.select(*alike, "d", bucket.alias("bucket")).repartition(tasks, "bucket")  # by numbers of cells, not by their bytes
    masked = dealt.groupBy("bucket").applyInPandas(_sorted_cells, "c1 long, c2 long, around binary, first int, last int, d long, mask long")
    masked = held.written(masked, "cell-masks")
    found = full.unionByName(masked.where("mask <> 0").select(*alike, "mask"))
    if (hot := masked.where(F.col("d") > PER_CORE)).limit(1).count():
        at = hot.select(*alike, F.explode(F.sequence("first", "last")).alias("k"))
        at = at.withColumn("bytes", F.substring(F.col("around"), F.col("k") + 1, F.lit(SIDE)))
        again = at.groupBy("c1", "c2", "k", "bytes").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        found = found.unionByName(at.join(again, ["c1", "c2", "k", "bytes"]).select(*alike, F.expr("shiftleft(1L, k)").alias("mask")))
    found = held.written(found.groupBy(*alike).agg(F.bit_or("mask").alias("mask")), "cells-found")  # so that the join below is one that Spark splits where it is hot
    parts = cells.join(found, alike).select("id", "tkey", F.col("base").alias("lo"), F.lit(None).cast("long").alias("hi"), "mask")
    return twins.unionByName(parts)


def covered(n: int, spans: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """The removed runs of a text of n bytes, as rows (start, end)."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans or ():
        if s["mask"] is None:
            edge[s["lo"]] += 1
            edge[s["hi"] + length] -= 1
        else:
            at = s["lo"] + np.flatnonzero((s["mask"] >> np.arange(CELL)) & 1)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
    inside = np.concatenate([[False], np.cumsum(edge[:n]) > 0, [False]]).astype(np.int8)
    return np.stack([np.flatnonzero(np.diff(inside) > 0), np.flatnonzero(np.diff(inside) < 0)], axis=1)


_OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def _without(raw: bytes, gone: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in gone.tolist():
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _cut(digest: bool, length: int):
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for x, s in zip(text.to_pylist(), spans.to_pylist()):
            raw = (x or "").encode("utf-8", "surrogatepass")
            gone = covered(len(raw), s, length) if s else np.zeros((0, 2), np.int64)
            whole = _without(raw, gone)
            rows.append((len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(whole).hexdigest() if digest else None, None if digest else whole))
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return F.arrow_udf(cut, _OUT)


def _cut_text(length: int):
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, s in zip(text.to_pylist(), spans.to_pylist()):
            raw = x.encode("utf-8", "surrogatepass") if s else b""
            gone = covered(len(raw), s, length) if s else ()
            out.append(_without(raw, gone).decode("utf-8", "ignore") if len(gone) else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, T.StringType())


def _measured(length: int):
    """Of a text's spans: the bytes that they cover, and the longest stretch of such bytes."""

    def measure(spans: pa.Array) -> pa.Array:
        flat, n = spans.flatten(), len(spans)
        own = np.repeat(np.arange(n), pc.list_value_length(spans).to_numpy())
        lo, mask = flat.field("lo").to_numpy(), flat.field("mask").fill_null(1).to_numpy()
        hi = pc.coalesce(flat.field("hi"), flat.field("lo")).to_numpy()
        # the windows of a cell overlap, so that those of its lowest and highest bit bound what they cover
        low, high = (np.frexp(x.astype(np.float64))[1] - 1 for x in (mask & -mask, mask))
        start, end = (own << 40) + lo + low, (own << 40) + hi + high + length
        order = np.argsort(start)
        own, start, end = own[order], start[order], np.maximum.accumulate(end[order])
        new = np.concatenate([[True], start[1:] > end[:-1]])[: len(own)]
        own, sizes = own[new], end[np.concatenate([new[1:], [True]])[: len(own)]] - start[new]
        found, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(found, own, sizes)
        np.maximum.at(longest, own, sizes)
        return pa.StructArray.from_arrays([pa.array(found), pa.array(longest)], ["n_repeated", "longest"])

    return F.arrow_udf(measure, "n_repeated long, longest long")


def _of_texts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("id", "tkey").agg(F.collect_list(F.struct("lo", "hi", "mask")).alias("spans"))


def _with_texts(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left with what right holds on its id and tkey."""
    right = right.withColumnsRenamed({"id": "s_id", "tkey": "s_tkey"})
    return left.join(right, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("tkey") == F.col("s_tkey")), how).drop("s_id", "s_tkey")


def _nested(docs: DataFrame, length: int, shorter: int) -> DataFrame:
    """From rows (id, text, tkey): rows (id, tkey, n_repeated, spans), with the bytes in strings of `shorter` bytes that also start elsewhere, and the spans of those of `length` bytes.

    Whatever is part of a string that repeats, repeats. So a repeated string of `length` bytes lies in a stretch of
    repeated shorter ones, and only texts with such a stretch as long as that are searched for it.
    """
    if shorter > length:
        raise ValueError(f"shorter strings of at most {length} bytes, not {shorter}")
    with Scratch(docs.sparkSession) as held:
        some = _of_texts(_spans(docs, shorter, held)).select("id", "tkey", _measured(shorter)("spans").alias("m"))
        some = written(some.select("id", "tkey", "m.n_repeated", "m.longest"), "repeated-bytes")
    with Scratch(docs.sparkSession) as held:
        long = held.written(_with_texts(docs, some.where(F.col("longest") >= length), "left_semi"), "texts-with-repeats")
        spans = repeated_spans(long, length)
    return _with_texts(some.drop("longest"), _of_texts(spans), "left")


def _spanned(docs: DataFrame, id_col: str, text_col: str, length: int, shorter: int | None = None) -> DataFrame:
    """row, text and spans of every document, with `shorter` also n_repeated. For each length, texts are shuffled to those of their runs that need cells; once, they are to the spans found."""
    packed = lean_batches(docs).select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("tkey", row_key())
    texts = packed.select("id", "text", "tkey")
    return _with_texts(packed, _of_texts(repeated_spans(texts, length)) if shorter is None else _nested(texts, length, shorter), "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """docs with a struct column `repeats`: n_bytes, n_removed, n_spans and kept, the bytes that stay (with digest, their sha256 alone).

    With `shorter`, also n_repeated: the text's bytes in strings of that many bytes that also start elsewhere. They are counted, not removed.
    """
    spanned = _spanned(docs, id_col, text_col, length, shorter)
    counted = [] if shorter is None else [F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated")]
    return spanned.select("row", _cut(digest, length)("text", "spans").alias("repeats"), *counted)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes cut out of their texts; what a cut leaves of a character goes too. Null texts stay null. One function in Python does it, so that a task holds one Python worker, not two."""
    cut = _spanned(docs, id_col, text_col, length).select("row", _cut_text(length)("text", "spans").alias("new"))
    new = F.coalesce("new", F.col("row")[text_col])
    return cut.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; n_repeated_256, its bytes in strings of PASSAGE bytes that repeat, as passages of over 50 words do that are too short to be removed."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    found = remove_repeats(docs, digest=True, shorter=PASSAGE)
    return found.select("row.doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256", F.col("n_repeated").alias(f"n_repeated_{PASSAGE}"))
