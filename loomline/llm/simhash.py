"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are dealt out by their leading bits, which is dealing them out in Gray order: all with one
prefix are neighbours in Gray rank. A prefix with too many fingerprints is divided by its next bits, again
and again, so the upper nodes of the index are prefixes of unequal depth. A query goes down that tree with
the number of bits in which it differs from the prefix so far, and leaves each branch where that number
passes the limit. Below a leaf prefix, one task sorts the fingerprints by Gray rank, joins runs of
neighbours into nodes that hold the bits their members share, and prunes whole nodes by accumulated differences.

Null and empty texts, and texts without words, have fingerprint zero, linked like any other. Repeated rows and
exact copies share a fingerprint and are one node. A null doc_id joins a component but never names it, so a
component of null ids only is null. An empty table gives no rows. Only distinct fingerprints are ever paired,
and each task hands on a spanning star per local component, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import components, lean_batches, read_documents
from loomline.session import written

#: Words of a shingle and the seed of its hash; most differing bits of a link.
SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: A leaf prefix holds at most this many fingerprints, unless all 64 bits are used up; bits of a further level.
LEAF, STEP = 4096, 6
#: Children of a node inside a leaf.
FANOUT = 8


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is set if over half of the shingles' hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters; ASCII white space
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, votes, digest = len(words) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        some = words[at : at + (1 << 16) + width - 1]
        codes = np.array([digest(x, SEED) for x in map(b" ".join, zip(*(some[k:] for k in range(width))))], "<u8")
        votes += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x or "") for x in text.to_pylist()], np.uint64).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""
    return _fingerprints(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under nodes of FANOUT children; a node holds the bits that its members share and its parent does not."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        levels = []
        ones, zeros = self.codes, ~self.codes  # bits that are 1, and 0, in all members
        while len(ones) > FANOUT:
            starts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            levels.append((ones, ones | zeros))
        self.levels = levels[::-1]  # from the top

    def search(self, queries: np.ndarray, most: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, position in codes) at most `most` bits apart."""
        found = [self._block(queries[k : k + block], most, k) for k in range(0, len(queries), block)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def _block(self, queries: np.ndarray, most: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.levels[0][0]) if self.levels else len(self.codes)
        q, at = np.repeat(np.arange(len(queries)), width), np.tile(np.arange(width), len(queries))
        spent, above = np.zeros(len(q), np.uint8), None
        for depth, (shared, mask) in enumerate(self.levels):
            own = mask if above is None else mask & ~above[np.arange(len(mask)) // FANOUT]
            spent = spent + np.bitwise_count((queries[q] ^ shared[at]) & own[at])
            near = spent <= most
            q, at, spent = q[near], at[near], spent[near]
            size = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.codes)
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            q, spent, inside = np.repeat(q, FANOUT), np.repeat(spent, FANOUT), at < size
            q, at, spent, above = q[inside], at[inside], spent[inside], mask
        near = np.bitwise_count(queries[q] ^ self.codes[at]) <= most
        return q[near] + first, at[near]


def _star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links a-b among n nodes, the least node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, root):
            return root
        root = new


def _leaf_links(most: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["fp"].to_numpy(np.int64).view(np.uint64)
        member = rows["member"].to_numpy(bool)
        index = GrayIndex(codes[member])
        everyone = np.concatenate([index.codes, np.unique(codes[~member])])
        q, at = index.search(everyone, most)
        root = _star(len(everyone), q, at)
        apart = root != np.arange(len(root))
        signed = everyone.view(np.int64)
        return pd.DataFrame({"a": signed[apart], "b": signed[root[apart]]})

    return links


def _prefix(fp: Column, bits: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - bits) if bits else F.lit(0).cast("long")


def _masks(bits: int, most: int) -> Column:
    """All masks of `bits` bits with at most `most` (at most 2) set, with that number: 1 + bits + bits * (bits - 1) / 2."""
    one = [1 << k for k in range(bits)]
    some = [(0, 0), *((m, 1) for m in one), *((m | k, 2) for i, m in enumerate(one) for k in one[:i])]
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("n")) for m, n in some if n <= most])


def link(fps: DataFrame, most: int = MOST_BITS, leaf: int = LEAF, step: int = STEP, keep=written) -> DataFrame:
    """From distinct fingerprints (column fp): links (a, b) whose components are those of all pairs at most `most` (0 to 2) bits apart. keep writes the tables that it reads."""
    n = fps.count()
    bits = min(64, max(0, (max(n, 1) // max(1, leaf // 2)).bit_length()))
    members = fps.select("fp", _prefix(F.col("fp"), bits).alias("cell"))
    ask = F.explode(_masks(bits, most)).alias("m")
    queries = members.select("fp", "cell", ask).select("fp", F.col("cell").bitwiseXOR(F.col("m.mask")).alias("cell"), F.col("m.n").alias("spent")).where(F.col("cell") <= _prefix(F.col("fp"), bits))
    done = []
    while True:
        sizes = members.groupBy("cell").agg(F.count("*").alias("size"))
        queries = queries.where("spent > 0").join(sizes.withColumnRenamed("cell", "c"), F.col("cell") == F.col("c")).drop("c")
        members = members.join(sizes, "cell")
        full = (F.col("size") > leaf) & F.lit(bits < 64)
        rows = keep(members.select("fp", "cell", "size", F.lit(True).alias("member"), F.lit(0).alias("spent")).unionByName(queries.select("fp", "cell", "size", F.lit(False).alias("member"), "spent")), "gray")
        done.append(rows.where(~full).select("fp", F.concat_ws("/", F.lit(bits), "cell").alias("cell"), "member"))
        again = rows.where(full)
        if bits >= 64 or again.limit(1).count() == 0:
            break
        deeper = min(step, 64 - bits)
        low = F.shiftrightunsigned(F.shiftleft("fp", bits), 64 - deeper)
        next_cell = lambda part: F.shiftleft("cell", deeper).bitwiseOR(part)
        members = again.where("member").select("fp", next_cell(low).alias("cell"))
        # members ask below their own cell too; of two sibling cells, the later one asks
        asks = again.select("fp", "cell", "member", "spent", low.alias("low"), F.explode(_masks(deeper, most)).alias("m")).where(F.col("spent") + F.col("m.n") <= most)
        asks = asks.where(~F.col("member") | (F.col("low").bitwiseXOR(F.col("m.mask")) < F.col("low")))
        queries = asks.select("fp", next_cell(F.col("low").bitwiseXOR(F.col("m.mask"))).alias("cell"), (F.col("spent") + F.col("m.n")).alias("spent"))
        bits += deeper
    rows = done[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("cell").applyInPandas(_leaf_links(most), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """A row per input row: doc_id, fp (signed) and component_id, the least doc_id that links reach."""
    fps = written(lean_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_of(F.col(f"`{text_col}`")).alias("fp")), "fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    found = components(link(nodes.select("fp"), most), "fp-links")
    labels = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(labels.join(names, "component").select(F.col("fp").alias("of"), "component_id"), "fp-names")
    return fps.join(named, fps["fp"] == named["of"]).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one stays per component: the one whose id names it; of repeated rows with that id, one. Null ids go where any other is linked."""
    own = docs.columns
    groups = near_duplicates(docs, id_col, text_col)
    picked = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("fp").alias("fp"))
    # null ids have no name: the component of null ids only keeps one row per fingerprint
    nulls = groups.where("doc_id is null and component_id is null").select("component_id", "fp").distinct()
    picked = picked.where("component_id is not null").unionByName(nulls)
    named = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("k_id")
    picked = picked.select(named(F.col("component_id")), F.col("fp").alias("k_fp"))
    rows = lean_batches(docs).select(F.struct("*").alias("row"), named(F.col(f"`{id_col}`")), fingerprint_of(F.col(f"`{text_col}`")).alias("k_fp"))
    rows = rows.join(picked, ["k_id", "k_fp"], "left_semi")  # the grouping below keeps the join's partitioning
    return rows.groupBy("k_id", "k_fp").agg(F.first("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in own])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    out = near_duplicates(read_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
