"""How the sources of a language differ in their terms, with the frequent terms found by iceberg prefix refinement.

A term is a run of letters A-Z and of characters beyond ASCII, A-Z in lower case. Texts are read once: each task counts,
for the texts of a batch and by language, in how many rows each byte prefix of 2, 4, 8, ... bytes occurs, and each whole
term, with its occurrences by source; rows are whole in a batch, so these add up. Then, level by level, the
counts of the prefixes that extend those kept so far are summed, and prefixes in fewer than `least` rows are discarded
with all that extends them; a term is complete at the first level that is as long as it, and the loop ends when every kept
prefix is a whole term. So the long tail of rare terms is never shuffled whole. Kept prefixes and terms are broadcast only up to a stated size, else joined.

Sources are then compared over blocks of terms and tiles of sources: each task fills a small matrix, sums absolute
differences of shares per pair of sources, and sums of blocks are added; no pair is emitted per term. Arithmetic is
on whole numbers throughout.

Null texts, languages and sources count as empty strings. Every row counts as a document, repeated rows and rows without
an id too. Groups without terms take part with counts of 0; a language without kept terms has pairs of value 0 and no
term rows. Equal values are ranked by the item's bytes. Very long terms take one level per doubling. An empty table
gives no rows. Columns other than those named are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import if_small, lean_batches, merged, read_documents
from loomline.llm.tokens import array_of, bytes_of
from loomline.session import Scratch, written

LEAST, TOP = 30, 50
#: Terms of a block, and sources of a tile, at most about.
TERMS, TILE = 1024, 256
#: Prefixes broadcast at most: so many rows, and so many bytes.
ROWS, BYTES = 50_000, 4_000_000
#: The same for kept terms.
TERM_ROWS, TERM_BYTES = 400_000, 8_000_000
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def term_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each term its text's place and its number among the distinct terms, and those terms as bytes."""
    data, offsets = bytes_of(text)
    inside = _LETTER[data]
    edge = np.empty(len(data), bool)
    edge[:1] = inside[:1]
    edge[1:] = inside[1:] & ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    edge[first] = inside[first]
    starts = np.flatnonzero(edge)
    last = np.empty(len(data), bool)
    last[-1:] = inside[-1:]
    last[:-1] = inside[:-1] & (~inside[1:] | edge[1:])
    stops = np.flatnonzero(last) + 1
    own = np.searchsorted(offsets, starts, side="right") - 1
    flat = _LOWER[data[inside]]
    coded = array_of(flat, np.concatenate([[0], np.cumsum(stops - starts)])).dictionary_encode()
    return own, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _pairs(a: np.ndarray, b: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b), b under n, and how often each comes, or the sum of its weights."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    key = a * n + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n_each = np.diff(np.append(at, len(key))) if weight is None else np.add.reduceat(weight[order], at)
    return key[at] // n, key[at] % n, n_each


_TOLD = "level int, lang string, term binary, whole boolean, n long, counts array<struct<source:string,n:long>>"


def gathered(docs: DataFrame) -> DataFrame:
    """From rows (lang, source, text): for each level L, in how many rows n of a language a prefix of L bytes occurs, or a whole term no longer, with its occurrences by source."""

    def run(batches):
        for batch in merged(batches, "text", 1 << 23):
            own, code, terms = term_codes(batch["text"])
            if not len(code):
                continue
            lang, source = (batch[c].dictionary_encode() for c in ("lang", "source"))
            of_lang, of_source = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
            sizes, many = pc.binary_length(terms).to_numpy(zero_copy_only=False), len(terms)

            def rows(level, langs, codes, words, n, counts=None):
                k = len(langs)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, level, np.int32)), lang.dictionary.take(pa.array(langs)), words.take(pa.array(codes)), pa.array(np.full(k, counts is not None)), pa.array(n.astype(np.int64)), pa.nulls(k, kind) if counts is None else counts],
                    names=["level", "lang", "term", "whole", "n", "counts"],
                )

            doc, code, times = _pairs(own, code, many)
            each, at, n = _pairs(of_lang[doc] * many + code, of_source[doc], len(source.dictionary), times)  # by language and term, then by source
            first = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
            counts = pa.ListArray.from_arrays(pa.array(np.append(first, len(each)).astype(np.int32)), pa.StructArray.from_arrays([source.dictionary.take(pa.array(at)), pa.array(n.astype(np.int64))], ["source", "n"]))
            kind, whole_lang, whole_code = counts.type, each[first] // many, each[first] % many
            whole_rows = _pairs(of_lang[doc], code, many)[2]
            level, longest = 2, int(sizes.max())
            while True:
                size = sizes[whole_code]
                done = (size <= level) & ((size > level // 2) | (level == 2))
                yield rows(level, whole_lang[done], whole_code[done], terms, whole_rows[done], counts.filter(pa.array(done)))
                if longest <= level:
                    break
                more = sizes[code] > level
                doc, code = doc[more], code[more]
                cut = pc.binary_slice(terms, 0, level).dictionary_encode()
                d, p, _ = _pairs(doc, cut.indices.to_numpy().astype(np.int64)[code], len(cut.dictionary))
                a, p, n = _pairs(of_lang[d], p, len(cut.dictionary))
                yield rows(level, a, p, cut.dictionary, n)
                level *= 2

    return docs.mapInArrow(run, _TOLD)


def frequent_terms(told: DataFrame, least: int, tables: Scratch) -> DataFrame:
    """(lang, term) of the terms that at least `least` rows of a language hold, from the levels of gathered()."""
    kept, alive, level = [], None, 2
    while True:
        rows = told.where(F.col("level") == level).select("lang", "term", "whole", "n")
        if alive is not None:
            up = if_small(alive.select(F.col("lang").alias("up_lang"), F.col("term").alias("up")), min(ROWS, BYTES // level))
            rows = rows.join(up, (F.col("lang") == F.col("up_lang")) & (F.substring("term", 1, level // 2) == F.col("up")), "left_semi")
        found = tables.written(rows.groupBy("lang", "term", "whole").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n"), "prefixes")
        kept.append(found.where("whole").select("lang", "term"))
        alive = found.where("not whole")
        if not alive.head(1):
            break
        level *= 2
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return tables.written(out, "terms")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in decimals of whole numbers, so that no size overflows; 0 without terms."""
    whole = lambda x: x.cast("decimal(19,0)")
    part = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (whole(count) + F.lit(5)), whole(total) + F.lit(5) * whole(terms))
    return F.when(terms > 0, part + 1).otherwise(F.lit(0)).cast("long")


def _matrix(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Differences of two tiles of sources over one block of terms, beyond those of their shares at count 0."""
    side, g, p = (table[c].to_numpy() for c in ("side", "g", "p"))
    term = table["term"].combine_chunks().dictionary_encode()
    at, head = term.indices.to_numpy(zero_copy_only=False), term.is_null().to_numpy(zero_copy_only=False)
    code = np.where(head, -1, np.nan_to_num(at, nan=-1)).astype(np.int64)
    tiles = []
    for s in (0, 1):
        own = head & (side == s)
        groups, order = g[own], np.argsort(g[own])
        groups, zero = groups[order], p[own][order]
        full = np.repeat(zero[:, None], len(term.dictionary), axis=1)
        cells = ~head & (side == s)
        full[np.searchsorted(groups, g[cells]), code[cells]] = p[cells]
        tiles.append((groups, zero, full))
    (ga, za, fa), (gb, zb, fb) = tiles
    out = np.zeros((len(ga), len(gb)), np.int64)
    for k in range(len(ga)):
        out[k] = np.abs(fb - fa[k]).sum(1) - np.abs(zb - za[k]) * fa.shape[1]
    a, b = np.repeat(ga, len(gb)), np.tile(gb, len(ga))
    own = a != b
    n = int(own.sum())
    return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "a": a[own], "b": b[own], "more": out.ravel()[own]})


def pair_differences(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, a, b, value): for every two sources of a language, the sum of absolute differences of their shares over its kept terms.

    groups: (lang, g, zero, terms, tiles, blocks), zero the share at count 0; cells: (lang, g, term, p, tiles, blocks), where the count is over 0.
    """
    head = groups.select("lang", "g", F.lit(None).cast("binary").alias("term"), F.col("zero").alias("p"), "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    body = cells.select("lang", "g", "term", "p", "tiles", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    rows = head.unionByName(body).withColumn("tile", F.floor(F.col("g") / TILE).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sides = F.when(F.col("other") == F.col("tile"), F.array(F.lit(0), F.lit(1))).when(F.col("other") > F.col("tile"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), F.explode(sides).alias("side"), "g", "term", "p")
    more = rows.groupBy("lang", "block", "ta", "tb").applyInArrow(_matrix, "lang string, a int, b int, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    upper = F.floor(F.col("a") / TILE) < F.floor(F.col("b") / TILE)  # of two tiles each pair comes one way round
    more = more.unionByName(more.where(upper).select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    zero = lambda g: groups.select(F.col("lang").alias(f"{g}_lang"), F.col("g").alias(f"{g}_g"), F.col("zero").alias(f"{g}_zero"), *(["terms"] if g == "a" else []))
    both = more.join(zero("a"), (F.col("lang") == F.col("a_lang")) & (F.col("a") == F.col("a_g"))).join(zero("b"), (F.col("lang") == F.col("b_lang")) & (F.col("b") == F.col("b_g")))
    return both.select("lang", "a", "b", (F.col("more") + F.col("terms") * F.abs(F.col("a_zero") - F.col("b_zero"))).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: part `pair` tells how far each other source of the language lies, part `term` the terms that the source uses most beyond its language."""
    spark = docs.sparkSession
    rows = lean_batches(docs).select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    with Scratch(spark) as tables:
        told = tables.written(gathered(rows), "terms-told")
        kept = frequent_terms(told, least, tables)
        n, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.length("term") + F.length("lang")), F.lit(0))).first()
        few = F.broadcast(kept) if n <= TERM_ROWS and size <= TERM_BYTES else kept
        counts = told.where("whole").select("lang", "term", "counts").join(few, ["lang", "term"], "left_semi").select("lang", "term", F.inline("counts"))
        counts = tables.written(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "counts")
        by_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("terms"))  # a row per language
        sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # over a language's sources, of which every two are in the result
        groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(by_lang, "lang", "left")
        groups = groups.select("lang", "source", number.cast("int").alias("g"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
        most = Window.partitionBy("lang")
        groups = groups.withColumns({"zero": share(F.lit(0), F.col("total"), F.col("terms")), "tiles": F.ceil(F.count("*").over(most) / TILE).cast("int"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int")})
        groups = written(groups, "groups")
        cells = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
        cells = written(cells.select("lang", "source", "g", "term", "n", "p", "terms", "lang_total", "tiles", "blocks"), "cells")
    names = groups.select("lang", "g", "source")
    pairs = pair_differences(groups, cells)
    pairs = pairs.join(names.withColumnRenamed("g", "a"), ["lang", "a"]).join(names.select("lang", F.col("g").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    whole = cells.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.first("lang_total").alias("lang_total"), F.first("terms").alias("terms"))
    whole = whole.select("lang", "term", share(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"))
    above = cells.select("lang", "source", "term", "p").join(whole, ["lang", "term"]).where("p > q")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY ALL HAVING count(*) >= %d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) AS g
      LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS q FROM l JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= %d
""" % (LEAST, TOP)
