"""Texts of numbers, addresses and times, JSON with dotted names, and elementwise functions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.strings import col


def escaped(s) -> Column:
    """Quotes, backslashes and newlines behind a backslash."""
    out = F.replace(col(s), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def quoted_list(a) -> Column:
    """An array as 'a' 'b' 'c'."""
    return F.array_join(F.transform(col(a), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), " ")


def quoted_item(s, k: int) -> Column:
    """The k-th item, from 0, of a quoted list; empty beyond it."""
    return F.coalesce(F.get(F.regexp_extract_all(col(s), F.lit("'([^']*)'"), F.lit(1)), F.lit(k)), F.lit(""))


def with_word(s, word) -> Column:
    """s with a word behind it, and a space between if there is anything before."""
    return F.when(F.length(col(s)) > 0, F.concat_ws(" ", col(s), col(word))).otherwise(col(word))


def swapped_words(s, i: int, j: int) -> Column:
    """Words i and j, from 0, in each other's place; s as it is where one is missing."""
    w = F.split(col(s), " ")
    swapped = F.transform(w, lambda x, k: F.when(k == i, F.get(w, F.lit(j))).when(k == j, F.get(w, F.lit(i))).otherwise(x))
    return F.when(F.size(w) > max(i, j), F.array_join(swapped, " ")).otherwise(col(s))


def duration_text(seconds) -> Column:
    """Days, hours, minutes and seconds as 1d 02h 03m 04s."""
    s = col(seconds).cast("long")
    part = lambda x, unit: F.concat(F.lpad(x.cast("string"), 2, "0"), F.lit(unit))
    return F.concat(F.floor(s / 86400).cast("string"), F.lit("d "), part(F.floor(s % 86400 / 3600), "h "), part(F.floor(s % 3600 / 60), "m "), part(s % 60, "s"))


def shifted(x, by) -> Column:
    """The absolute value of x shifted left by a number of bits, or right by a negative one."""
    n, k = F.abs(col(x).cast("long")), col(by)
    return F.when(k >= 0, n * F.pow(F.lit(2), F.abs(k)).cast("long")).otherwise(F.floor(n / F.pow(F.lit(2), F.abs(k))).cast("long"))


def address_class(address) -> Column:
    """The class of an IPv4 address by the ranges set aside for it, else public; null for what is no address."""
    parts = F.transform(F.split(col(address), r"\."), lambda x: x.try_cast("int"))
    ok = (F.size(parts) == 4) & F.forall(parts, lambda x: F.coalesce((x >= 0) & (x < 256), F.lit(False)))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    kind = F.when(a == 127, "loopback").when((a == 169) & (b == 254), "link").when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private").when((a == 100) & b.between(64, 127), "shared").when(a >= 224, "multicast")
    return F.when(ok, F.coalesce(kind, F.lit("public")))


def column_kind(s) -> Column:
    """empty, integer, number or text, by how a value reads."""
    x = F.trim(col(s))
    return F.when(col(s).isNull() | (x == ""), "empty").when(x.rlike(r"^[+-]?\d+$"), "integer").when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "number").otherwise("text")


def wild_find(a, kind: str, word: str) -> Column:
    """The place, from 0, of the first string in a that is word (whole), begins (left), ends (right) or goes on (middle) with it; -1 for none."""
    test = {"whole": lambda x: x == word, "left": lambda x: x.startswith(word), "right": lambda x: x.endswith(word), "middle": lambda x: x.contains(word)}[kind]
    hits = F.transform(col(a), lambda x: F.coalesce(test(x), F.lit(False)))
    return F.array_position(hits, F.lit(True)) - 1


def circular_overlap(a0, a1, b0, b1, ring: float) -> Column:
    """Whether arcs [a0, a1) and [b0, b1) of a ring meet; an arc may pass its end."""
    length = lambda x0, x1: F.pmod(col(x1) - col(x0), F.lit(ring))
    return (F.pmod(col(b0) - col(a0), F.lit(ring)) < length(a0, a1)) | (F.pmod(col(a0) - col(b0), F.lit(ring)) < length(b0, b1))
