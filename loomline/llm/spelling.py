"""Spelling variants: words one code point apart, by a dictionary of trie-node pairs.

Every distinct prefix of the words is a node of a trie, every distinct suffix one of the trie of reversed words, and both are
numbered. A word gives an integer pair (prefix node, suffix node) for each position that is skipped and for each place
where a code point could be inserted. Two words whose skipped pairs are equal differ by one replaced code point; one whose
skipped pair equals another's open place differs by one inserted or deleted code point. Node numbers stand for
strings exactly, so the joins give the neighbours themselves and nothing is to be verified. Words that share a skipped pair are
at most as many as letters (90 here), however many words there are; in a run of equal letters only the first
is skipped to delete it, so a pair of words meets once.

Counts are taken in the tasks that read the texts and added up by word; short words are dropped before. The nodes of up to
two letters, which many words share, are broadcast (at most 1 + 90 + 8,100 of them); the others are joined by merging, as Spark sizes
what is exploded from a small table of words like that table, and would broadcast it. Roots are found by pointer
doubling: a form has at least `ratio` times the occurrences of its word, so a chain of forms is short.

Null texts have no words; a null id counts as an empty string. Repeated rows count again. Very long runs of letters are
words like others. Ties between forms go to the least word in code-point order. Empty tables, and tables without frequent
words, give no rows. Columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import merged, read_documents, texts
from loomline.llm.divergence import _pairs, term_codes
from loomline.llm.tokens import array_of, bytes_of
from loomline.session import Scratch, written

LETTERS, TIMES, RATIO = 6, 5, 5
#: One run in so many, by its hash, loses a code point: misspellings that the contract plants.
MISSPELT = 199
#: Nodes of up to so many letters are broadcast.
SHALLOW = 2
_ASCII = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def runs(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each run of A-Z, a-z and U+00C0 to U+00FF its text's place and its number among the distinct runs, A-Z in lower case, and those as bytes."""
    data, offsets = bytes_of(text)
    inside = _ASCII[data] | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3  # the second byte of U+00C0 to U+00FF
    return term_codes(array_of(np.where(inside, data, np.uint8(32)), offsets))


def word_counts(rows: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n) over rows (doc_id, text), words of at least `letters` code points, each MISSPELT-th run by its hash misspelt."""

    def count(batches):
        for batch in merged(batches, "text", 1 << 23):
            own, code, found = runs(batch["text"])
            if not len(code):
                continue
            doc, code, times = _pairs(own, code, len(found))
            words = found.to_pylist()
            heads = [zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in batch["doc_id"].to_pylist()]
            hashes = np.fromiter((zlib.crc32(words[c], heads[d]) for d, c in zip(doc.tolist(), code.tolist())), np.int64, len(code))
            wrong = hashes % MISSPELT == 0
            total = np.bincount(code[~wrong], times[~wrong], len(words)).astype(np.int64)
            new: dict[str, int] = {}
            for h, c, n in zip(hashes[wrong].tolist(), code[wrong].tolist(), times[wrong].tolist()):
                w = words[c].decode()
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
                new[w] = new.get(w, 0) + n
            both = pa.concat_arrays([found.cast(pa.string()), pa.array(list(new), pa.string())])
            n = pa.array(np.concatenate([total, np.fromiter(new.values(), np.int64, len(new))]))
            keep = pc.and_(pc.greater_equal(pc.utf8_length(both), letters), pc.greater(n, 0))
            yield pa.RecordBatch.from_arrays([both.filter(keep), n.filter(keep)], names=["word", "n"])

    return rows.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbered(rows: DataFrame, part: str, node: str, tables: Scratch) -> DataFrame:
    """rows with a number for each distinct string in `part`, instead of it."""
    nodes = tables.written(rows.select(part).distinct().select(part, F.monotonically_increasing_id().alias(node)), node)
    few = F.length(part) <= SHALLOW
    return rows.where(few).join(F.broadcast(nodes.where(few)), part).unionByName(rows.where(~few).join(nodes.where(~few).hint("merge"), part)).drop(part)


def node_pairs(words: DataFrame, tables: Scratch) -> DataFrame:
    """(word, n, before, behind, skips, first): a row for each position that is skipped, and for each open place; first: no equal letter stands before it."""
    at = F.col("at")
    rows = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    rows = rows.select("word", "n", "at", F.explode(F.when(at < F.length("word"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("skips"))
    piece = lambda start, size: F.substring(F.col("word"), start, size)
    rows = rows.select("word", "n", "skips", ((at == 0) | (piece(at + 1, F.lit(1)) != piece(at, F.lit(1)))).alias("first"), piece(F.lit(1), at).alias("prefix"), piece(at + F.when(F.col("skips"), 2).otherwise(1), F.length("word")).alias("suffix"))
    return tables.written(_numbered(_numbered(rows, "prefix", "before", tables), "suffix", "behind", tables), "node-pairs")


def neighbours(words: DataFrame, tables: Scratch) -> DataFrame:
    """(word, near, near_n) of every two of words (word, n) that differ by one inserted, deleted or replaced code point, both ways."""
    pairs = node_pairs(words, tables)
    key = ["before", "behind"]
    skipped = pairs.where("skips").select(*key, "word", "n", "first")
    other = pairs.where("skips").select(*key, F.col("word").alias("near"), F.col("n").alias("near_n"))
    replaced = skipped.join(other.hint("merge"), key).where("word <> near").select("word", "near", "near_n")
    longer = skipped.where("first").withColumnsRenamed({"word": "long", "n": "long_n"})
    shorter = pairs.where("not skips").select(*key, F.col("word").alias("short"), F.col("n").alias("short_n"))
    inserted = longer.join(shorter.hint("merge"), key)
    ways = F.array(F.struct(F.col("long").alias("word"), F.col("short").alias("near"), F.col("short_n").alias("near_n")), F.struct(F.col("short").alias("word"), F.col("long").alias("near"), F.col("long_n").alias("near_n")))
    return replaced.unionByName(inserted.select(F.inline(ways)))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every one of words (word, n)."""
    with Scratch(words.sparkSession) as tables:
        near = neighbours(words, tables).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
        takes = -F.col("best.less") >= ratio * F.col("n")
        told = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
        told = written(told, "forms")
        links = tables.written(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
        while True:
            further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
            links = tables.written(links.join(further.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
            if not links.where("moved").head(1):
                break
            links = links.drop("moved")
        out = told.join(links.select("word", "root").hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return written(out, "variants")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word of the documents."""
    words = word_counts(texts(read_documents(spark, sf_dir))).where(F.col("n") >= TIMES)
    return variants(written(words, "words"))


def _crc_table() -> list[int]:
    out = list(range(256))
    for _ in range(8):
        out = [c >> 1 ^ 0xEDB88320 * (c & 1) for c in out]
    return out


ORACLE = rf"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1]))) AS h FROM b),
m AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {TIMES}),
s AS (SELECT word, n, substring(word, 1, i) AS pre, substring(word, i + 2) AS suf FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM w)),
x AS (SELECT DISTINCT s.word AS long, w.word AS short FROM s JOIN w ON w.word = s.pre || s.suf),
near AS (SELECT a.word, b.word AS near FROM s AS a JOIN s AS b ON a.pre = b.pre AND a.suf = b.suf AND a.word <> b.word UNION ALL SELECT long, short FROM x UNION ALL SELECT short, long FROM x),
best AS (SELECT near.word, near, w.n AS near_n, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near) AS k, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN w ON w.word = near),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND k = 1),
c(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL
"""
