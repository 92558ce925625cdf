"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts with one set of shingles are one node, with a SimHash fingerprint. All fingerprints go through operator 3's
Gray-order hierarchical index (simhash.py); what it finds within MOST_BITS bits is compared exactly and, where similar, linked. Few pairs at
0.8 are that close, so nodes that share a band of BAND minima under one of BANDS hashes are compared too. Of the nodes that are
compared, one text each is read again for its shingles, so that no other text's are kept, and only pairs whose exact
similarity (of the sets of 64-bit digests) suffices are linked. A pair at 0.8 shares no band with a probability
of 7 in 100,000, closer pairs far more seldom.

A bucket of few nodes compares all its pairs. A larger one is dealt into parts, and a task compares the nodes of a part, but
never two that it has linked already. After one component search, the nodes of a bucket that are outside its largest
component are compared with all nodes of its other parts, again part by part. So texts travel once for each part that
they meet, not once for each pair, a group of near copies that its parts link is done without its pairs, and no pair of a bucket is left out.

Null and empty texts and texts without words are one node. Texts of fewer than WIDTH words are one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import simhash
from loomline.llm.common import components, if_small, lean_batches, row_key
from loomline.session import Scratch, written

#: Words of a shingle and the seed of its hash.
WIDTH, SEED = 5, 42
#: Hashes, and minima of each that have to agree.
BANDS, BAND = 24, 5
#: A bucket of at most this many nodes compares all pairs at once; a part of a larger one holds about so many shingles.
SMALL, PART = 6, 16_384

_DRAWN = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND), np.int64).astype(np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct digests of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters; ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    width = min(WIDTH, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(width))))), np.uint64))


def bands(codes: np.ndarray) -> list[int]:
    """A signed 64-bit key per band; none for no shingles."""
    if not len(codes):
        return []
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for k in range(0, len(codes), 4096):
        mixed = (codes[k : k + 4096, None] ^ _FLIP) * _TIMES
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint(codes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of digests, as a signed 64-bit integer: a bit is set if over half of them have it."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(codes), 1 << 16):
        votes += np.unpackbits(codes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(codes), bitorder="little").view("<i8")[0])


#: Nodes whose texts are found by a broadcast of their ids; beyond, by a shuffle.
BROADCAST = 500_000
_SKETCH = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])


@F.arrow_udf(_SKETCH)
def _sketch(text: pa.Array) -> pa.Array:
    sets = [shingles(x or "") for x in text.to_pylist()]
    nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
    prints = pa.array([fingerprint(s) for s in sets], pa.int64())
    return pa.StructArray.from_arrays([nodes, pa.array([bands(s) for s in sets], pa.list_(pa.int64())), prints], ["node", "bands", "fp"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingles(text: pa.Array) -> pa.Array:
    sets = [shingles(x or "") for x in text.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sets (node, shingles, n) are similar enough: i / (m + n - i) >= 0.8."""
    sized = sets.select("node", "n")
    both = pairs.join(sized.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sized.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    both = both.where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _close(rows: DataFrame, held: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes to compare, from rows (node, fp): the least nodes of fingerprints that the Gray-order index links, and those of one fingerprint."""
    least = held.written(rows.groupBy("fp").agg(F.min("node").alias("node")), "copies-prints")
    named = lambda fp, node: least.select(F.col("fp").alias(fp), F.col("node").alias(node))
    linked = simhash.link(least.select("fp"), keep=held.written).withColumnsRenamed({"a": "x", "b": "y"}).join(named("x", "a"), "x").join(named("y", "b"), "y").select("a", "b")
    same = rows.select("fp", F.col("node").alias("b")).join(named("fp", "a"), "fp").where("a <> b").select("a", "b")
    return held.written(linked.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "copies-close")


def _meet(rows: pa.Table) -> pa.Table:
    """Links (a, b) between components by similar pairs of rows (component, asks, shingles): those that ask are compared with all others, but never two that are linked already."""
    sets = rows["shingles"].combine_chunks()
    n = pc.list_value_length(sets).to_numpy().astype(np.int64)
    starts = np.cumsum(n) - n
    known, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    names = rows["component"].combine_chunks().dictionary_encode()
    own = names.indices.to_numpy()
    now, mark, a, b = own.copy(), np.zeros(len(known), bool), [], []
    for r in np.flatnonzero(rows["asks"].to_numpy()):
        apart = now != now[r]
        if not apart.any():
            continue
        mine = codes[starts[r] : starts[r] + n[r]]
        mark[mine] = True
        shared = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        mark[mine] = False
        near = np.flatnonzero(apart & (9 * shared >= 4 * (n + n[r])))
        met, first = np.unique(now[near], return_index=True)
        a += [own[r]] * len(met)
        b += own[near[first]].tolist()
        now[np.isin(now, met)] = now[r]
    return pa.table({"a": names.dictionary.take(pa.array(a, pa.int64())), "b": names.dictionary.take(pa.array(b, pa.int64()))})


def _across(many: DataFrame, sets: DataFrame, found: DataFrame | None, held: Scratch) -> DataFrame:
    """Links (a, b) between components that pairs of nodes in different parts of a bucket show, from buckets (key, node, part, parts)."""
    live = many.where("parts > 1")
    if found is None:
        live = live.withColumn("component", F.col("node"))
    else:
        live = live.join(found.withColumnsRenamed({"node": "of", "component": "is"}), F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("is", "node")).drop("of", "is")
    counts = live.groupBy("key", "component").agg(F.count("*").alias("m"))
    # a bucket whose nodes are all linked is done
    largest = counts.groupBy("key").agg(F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("apart")).where("apart > 1").select("key", F.col("most.component").alias("most"))
    live = live.join(largest, "key").join(sets.select("node", "n"), "node").withColumn("out", F.col("component") != F.col("most"))
    groups = live.where("out").groupBy("key").agg(F.ceil(F.sum("n") / PART).alias("groups"))
    live = held.written(live.join(groups, "key").select("key", "node", "component", "part", "parts", "out", "groups"), "copies-apart")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = live.where("out").select("key", "node", "component", F.pmod(F.xxhash64("node"), "groups").alias("group"), each("parts").alias("part"), F.lit(True).alias("asks"))
    asked = live.select("key", "node", "component", each("groups").alias("group"), "part", F.lit(False).alias("asks"))
    both = asking.unionByName(asked).join(sets.select("node", "shingles"), "node").drop("node")
    return held.written(both.groupBy("key", "group", "part").applyInArrow(_meet, "a binary, b binary").distinct(), "copies-edges")


def link(rows: DataFrame, texts: DataFrame, small: int = SMALL) -> DataFrame | None:
    """Rows (node, component) of all linked nodes, from rows (doc_id, tkey, node, bands, fp) and their texts (doc_id, tkey, text); None without any."""
    found = None
    with Scratch(rows.sparkSession) as held:
        live = rows.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("key"))
        shared = live.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        live = held.written(live.join(shared, "key"), "copies-buckets")
        one = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tkey")).alias("r")
        close = _close(rows, held)
        met = live.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
        reps = rows.join(met, "node", "left_semi").groupBy("node").agg(one).select("node", F.col("r.doc_id").alias("r_id"), F.col("r.tkey").alias("r_tkey"))
        reps = if_small(held.written(reps, "copies-read"), BROADCAST)
        read = texts.join(reps, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tkey") == F.col("r_tkey"))).select("node", "text")
        sets = read.dropDuplicates(["node"]).select("node", _shingles("text").alias("shingles"))
        sets = held.written(sets.withColumn("n", F.size("shingles")), "copies-sets")
        few = live.where(F.col("m") <= small)
        pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
        pairs = held.written(pairs.unionByName(close).distinct(), "copies-pairs")
        many = live.where(F.col("m") > small).select("key", "node")
        parts = many.join(sets.select("node", "n"), "node").groupBy("key").agg(F.ceil(F.sum("n") / PART).alias("parts"))
        many = held.written(many.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts")), "copies-many")
        inside = many.join(sets.select("node", "shingles"), "node").select("key", "part", F.col("node").alias("component"), F.lit(True).alias("asks"), "shingles")
        inside = inside.groupBy("key", "part").applyInArrow(_meet, "a binary, b binary")
        edges = held.written(_similar(pairs, sets).unionByName(inside), "copies-edges")
        if edges.limit(1).count():
            found = components(edges, "copies")
        across = _across(many, sets, found, held)
        if across.limit(1).count():
            if found is not None:
                across = across.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = components(across, "copies")
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, held: Scratch | None = None) -> DataFrame:
    """A row per input row: doc_id, tkey (of its text) and component, a name that linked rows share. With held, it reads a table of held's."""
    texts = lean_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("tkey", row_key())
    keep = held.written if held else written
    rows = keep(texts.select("doc_id", "tkey", _sketch("text").alias("s")).select("doc_id", "tkey", "s.*"), "copies-sketch")
    found = link(rows, texts, small)
    rows = rows.select("doc_id", "tkey", "node")
    if found is None:
        return rows.withColumnRenamed("node", "component")
    found = found.withColumnRenamed("node", "of")
    return rows.join(found, F.col("node") == F.col("of"), "left").select("doc_id", "tkey", F.coalesce("component", "node").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """The rows of docs of which one stays per component: the one with the least id, null ids after all others; of several with that id, one."""
    own = docs.columns
    named = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("k_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("k")
    with Scratch(docs.sparkSession) as held:
        linked = near_copies(docs, id_col, text_col, small, held)
        picked = written(linked.groupBy("component").agg(least).select(named(F.col("k.doc_id")), F.col("k.tkey").alias("k_tkey")), "copies-picked")
    tkey = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), named(F.col(f"`{id_col}`")), tkey.alias("k_tkey"))
    rows = rows.join(picked, ["k_id", "k_tkey"], "left_semi")  # the grouping below keeps the join's partitioning
    return rows.groupBy("k_id", "k_tkey").agg(F.first("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in own])
