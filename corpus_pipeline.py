"""The corpus pipeline: five stages, each over all that the one before it kept, written and read again in between.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
No stage has an expression in SQL as a whole, so ORACLE_SQL is None and tests hold run() against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe_tree, mixing, near_copies, quality_rules, suffix_dedup
from loomline.llm.common import read_documents
from loomline.session import written


#: Bytes of a string that may not repeat across documents: under what 50 words of short words take.
REPEAT = 256


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles at a Jaccard similarity of 0.8 or more, found by fingerprints in operator 3's Gray-order index and by bands: the one with the least id."""
    return near_copies.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of strings of REPEAT bytes that repeat elsewhere."""
    return suffix_dedup.drop_repeats(docs, length=REPEAT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole, and once more by its first words where the last pass ends inside it."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each row."""
    import public_tokenizers

    return bpe_tree.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated strings", repeats), ("source mixture", mixture), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
