"""Quality rules with host verdicts.

Rules on a text give its base verdict; failures are then aggregated by host (source), each host's rate
is shrunk by an empirical beta prior, and a host whose shrunk rate is over MULTIPLE times the mean of hosts, a limit
kept between LEAST_RATE and MAX_RATE, rejects all its documents; one that only reaches the limit stays. So hosts fall by how they differ
from the others, and where they do not, clean documents are left alone.

Null texts are empty and fail (too few words). A null host is a host of its own. Repeated rows count
once each. Very long texts are measured whole. An empty table has no hosts and no rows. Other columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import if_small, lean_batches, read_documents
from loomline.session import written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A host is rejected if its shrunk rate of base failures is over so many times the mean rate of hosts, or over the limits of that limit.
MULTIPLE, LEAST_RATE, MAX_RATE = 2.0, 0.15, 0.7
#: Most hosts for which a table of them is broadcast; beyond that it is shuffled.
BROADCAST_HOSTS = 20_000
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = str.maketrans(dict.fromkeys("\x09\x0a\x0b\x0c\x0d", " "))


def _measure(text: str) -> tuple[int, int, int, int, int]:
    words = [w for w in text.translate(_SPACES).split(" ") if w]
    n, seen, dup = len(words), set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip("\x20\x09\x0b\x0c\x0d"):
            seen.add(line)
    covered = 0
    if n > WINDOW:
        code = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        mixed = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):  # a polynomial in an odd base, modulo 2**64
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[k : n - WINDOW + 1 + k]
        order = np.argsort(mixed, kind="stable")
        same = np.diff(mixed[order]) == 0
        if same.any():
            edge = np.zeros(n + 1, np.int64)
            again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            np.add.at(edge, again, 1)
            np.add.at(edge, again + WINDOW, -1)
            covered = int((np.cumsum(edge) > 0).sum())
    return n, sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, covered


@F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS]))
def _measures(text: pa.Array) -> pa.Array:
    rows = [_measure(x or "") for x in text.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)], list(_FIELDS))


def base_rules(text: Column) -> Column:
    """A struct of the base measures of a text, each over the whole of it."""
    return _measures(text)


def failed(measures: Column) -> Column:
    return (measures["n_words"] < MIN_WORDS) | (100 * measures["n_repeat_words"] > MAX_REPEAT_PERCENT * measures["n_words"])


def host_verdicts(judged: DataFrame) -> DataFrame:
    """From rows (host, base_failed): a row per host with n, fails, its shrunk rate and rejected.

    The beta prior has the mean and the variance of the hosts' rates (method of moments); where they
    allow none (one host, or no variance), it is worth one document at the mean rate.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    rate = F.col("fails") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1.0))
    prior = prior.select("m", weight.alias("weight"))  # one row
    shrunk = (F.col("fails") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "fails", shrunk.alias("rate"), (shrunk > F.least(F.lit(MAX_RATE), F.greatest(F.lit(LEAST_RATE), MULTIPLE * F.col("m")))).alias("rejected"))


def with_verdicts(judged: DataFrame, hosts: DataFrame) -> DataFrame:
    """Joins hosts back to rows that have host and base_failed, and adds host_rate, host_rejected and kept; hosts that are left out reject nothing."""
    told = if_small(hosts.select(F.col("host").alias("of_host"), F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected")), BROADCAST_HOSTS)
    joined = judged.join(told, judged["host"].eqNullSafe(told["of_host"]), "left").drop("of_host").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the base measures, base_failed, host_rate, host_rejected and kept of every row.

    Texts are measured once and only the measures are written out, so no text is shuffled.
    """
    m = base_rules(F.col(f"`{text_col}`"))
    rows = lean_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"), m.alias("m"))
    judged = written(rows.select("doc_id", "host", "m.*", failed(F.col("m")).alias("base_failed")), "quality")
    return with_verdicts(judged, written(host_verdicts(judged), "hosts"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns. Texts are measured twice rather than shuffled."""
    own = docs.columns
    packed = lean_batches(docs).select(F.struct("*").alias("row"), F.col(f"`{host_col}`").alias("host"), failed(base_rules(F.col(f"`{text_col}`"))).alias("base_failed"))
    hosts = written(host_verdicts(packed.select("host", "base_failed")), "hosts")
    return with_verdicts(packed, hosts.where("rejected")).where("kept").select(*[F.col("row")[c].alias(c) for c in own])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_documents(spark, sf_dir))
    return out.select("doc_id", *_FIELDS, "base_failed", F.round("host_rate", 9).alias("host_rate"), "host_rejected", "kept")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT r, sum(n - 1) AS n_dup FROM lines GROUP BY r),
grams AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
          FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT r, g FROM grams GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT j) AS n_rep
        FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM grams JOIN twice USING (r, g)) GROUP BY r),
base AS (SELECT w.r, doc_id, source, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words
         FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM j GROUP BY source),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 1.0 END AS k FROM p),
s AS (SELECT source, m, (f + m * k) / (n + k) AS rate FROM h, q),
bad AS (SELECT source, rate, rate > least({MAX_RATE}, greatest({LEAST_RATE}, {MULTIPLE} * m)) AS rejected FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, round(rate, 9) AS host_rate, rejected AS host_rejected, NOT base_failed AND NOT rejected AS kept
FROM j JOIN bad ON j.source IS NOT DISTINCT FROM bad.source
"""
