"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped for reading.

A set is a folder. Part k is part-k.ids (the documents' ids, one after another, in the narrowest
unsigned width that holds the vocabulary, little-endian) and part-k.idx (a count n, how many of the n have no
document id, then n document ids and n + 1 offsets in ids from the part's start, all little-endian signed 64-bit).
parts/ holds a row per part with its numbers of documents and ids and its base: the ids in all parts before it, a
prefix sum. Parts are in ascending order of doc_id, and so are the documents in each.

Null texts and empty ones hold the end id alone. Null doc_ids come first, in the index as 0. Rows with equal doc_id
are in the order of their text's hash, so that one id's many rows may lie in several parts; equal rows each get their
place. An empty table gives a set without parts.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import merged, texts
from loomline.llm.tokens import PieceEncoder, load
from loomline.session import scratch


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(uri: str, write) -> None:
    """Writes a file under another name and then renames it, so that a retried or doubled task leaves one whole file."""
    store, path = _open(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        write(f)
    store.move(part, path)


def mapped(uri: str) -> np.ndarray:
    """A file's bytes: memory-mapped where the store is a local or mounted folder, else read."""
    from pyarrow import fs

    store, path = _open(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.asarray(np.memmap(path, dtype=np.uint8, mode="r")) if os.path.getsize(path) else np.zeros(0, np.uint8)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=np.uint8)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 8192) -> DataFrame:
    """Encodes every text, appends end_id, writes the set, and returns its rows of parts/ (part, n_docs, n_ids, base).

    Documents are range-partitioned by doc_id and their text's hash, about rows_per_part to a part. Each task streams its
    part out; only the parts' totals, one small row each, are gathered for the prefix sum, by Spark.
    """
    spark, rows = docs.sparkSession, texts(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / rows_per_part))
    dealt = rows.repartitionByRange(parts, "doc_id", "tkey").sortWithinPartitions("doc_id", "tkey").drop("tkey")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        part, enc = TaskContext.get().partitionId(), None
        ids, lengths = [], []
        with tempfile.TemporaryFile() as spool:  # one part, until its file is put in place
            for batch in merged(batches, "text", 1 << 22):
                if enc is None:
                    width = 2 if max(load(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                    enc = PieceEncoder(tokenizer)
                flat, _, ends = enc.encode(batch["text"])
                whole = np.full(len(flat) + batch.num_rows, end_id, f"<u{width}")
                whole[np.arange(len(flat)) + np.repeat(np.arange(batch.num_rows), np.diff(ends))] = flat
                spool.write(whole)
                ids.append(batch["doc_id"])
                lengths.append(np.diff(ends) + 1)
            if not ids:
                return
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
            own = pa.concat_arrays(ids)
            index = np.concatenate([[len(own), own.null_count], own.fill_null(0).to_numpy(), offsets]).astype("<i8")
            name = f"{folder}/part-{part:06d}"

            def stream(f):
                spool.seek(0)
                while block := spool.read(1 << 22):
                    f.write(block)

            put(f"{name}.ids", stream)
            put(f"{name}.idx", lambda f: f.write(index.tobytes()))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "width": pa.array([width], pa.int32()), "n_docs": pa.array([len(own)], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64())})

    totals = dealt.mapInArrow(write, "part long, width int, n_docs long, n_ids long")
    totals.write.parquet(f"{folder}/totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    based = spark.read.schema(totals.schema).parquet(f"{folder}/totals").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    based.write.parquet(f"{folder}/parts")
    return spark.read.schema(based.schema).parquet(f"{folder}/parts")


def read_token_files(spark: SparkSession, folder: str, fields: str = "ids") -> DataFrame:
    """A row per document of the set: doc_id, start, n_tokens and ids (array of int), or with fields="digest" ids_crc32 in place of ids.

    Each task maps its parts' files and yields a few documents at a time; n_tokens counts the end id.
    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    parts = spark.read.parquet(f"{folder}/parts")
    last = "ids array<int>" if fields == "ids" else "ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/part-{row['part']:06d}"
                index, ids = mapped(f"{name}.idx").view("<i8"), mapped(f"{name}.ids").view("<u2" if row["width"] == 2 else "<u4")
                n, n_null = index[:2].tolist()
                docs, offsets = index[2 : n + 2], index[n + 2 :]
                for k in range(0, n, 512):
                    cut = offsets[k : k + 513]
                    own = docs[k : k + 512]
                    runs = [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]
                    data = {"doc_id": pa.array(own, pa.int64(), mask=np.arange(k, k + len(own)) < n_null), "start": pa.array(cut[:-1] + row["base"]), "n_tokens": pa.array(np.diff(cut))}
                    if fields == "ids":
                        data["ids"] = pa.array([x.astype(np.int32) for x in runs], pa.list_(pa.int32()))
                    else:
                        data["ids_crc32"] = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in runs], pa.int64())
                    yield pa.RecordBatch.from_pydict(data)

    return parts.repartition(F.col("part")).mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the set of files that the call writes."""
    import public_tokenizers

    from loomline.llm.common import read_documents

    folder = scratch(spark, "tokens")
    write_token_files(read_documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, folder, fields="digest")
