"""What several operators share: reading documents, words, bounded broadcasts and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import Scratch, table, written

#: A word: a run of characters other than space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at once: texts can be long, and a batch is held several times over.
BATCH_ROWS = 512


def lean_batches(df: DataFrame) -> DataFrame:
    """df, with the session set to hand at most BATCH_ROWS rows at once to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that no other column's name can clash; a null text counts as empty."""
    return lean_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def merged(batches, column: str, size: int = 1 << 24):
    """Record batches of about `size` bytes in a text column, joined from small ones and cut from large ones; a row stays whole."""
    held, total = [], 0
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + size - total, side="right")) - 1
            if to <= at and held:
                yield pa.concat_batches(held)
                held, total = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            total += int(ends[to] - ends[at])
            at = to
    if held:
        yield pa.concat_batches(held)


def word_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts, A-Z in lower case: for each word its text's place and its number among the distinct words, and those words as bytes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat = lists.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    own = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return own[real.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def row_key() -> Column:
    """Tells the rows of one doc_id apart by their text; equal rows share it, which every operator that joins on it allows for."""
    return F.xxhash64("text")


def fold(id_col: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def if_small(df: DataFrame, bound: int) -> DataFrame:
    """df with a broadcast hint if it has at most `bound` rows, which one count shows; else without, and Spark shuffles."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node in any edge; component is the least node reached.

    Alternates large-star and small-star steps; each round is written to the shared folder, so that
    lost executors cost one round; the round before is deleted then. Minima are aggregated before the shuffle, and the joins that follow
    are plain equi-joins, which Spark splits where a hub is hot. The driver sees two numbers a round.
    """
    old = Scratch(edges.sparkSession)
    links = old.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = Scratch(edges.sparkSession)
        links = new.written(stars, label)
        old.drop()
        old = new
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    out = written(roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), label)
    old.drop()
    return out
