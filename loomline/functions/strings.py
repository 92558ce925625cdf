"""String functions as Column expressions. Positions count code points from 0; a null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour codes: a caret with a digit, or with x and three hexadecimal digits.
COLOUR_CODE = r"\^(?:[0-9]|x[0-9A-Fa-f]{3})"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def decolour(s) -> Column:
    """s without colour codes."""
    return F.regexp_replace(col(s), COLOUR_CODE, "")


def visible_length(s) -> Column:
    return F.length(decolour(s))


def slice_text(s, start, length) -> Column:
    """A negative start counts from the end; a negative length leaves that many, less one, off the end (-1: to the end)."""
    s, start, length = col(s), F.lit(start), F.lit(length)
    n = F.length(s)
    at = F.greatest(F.when(start < 0, n + start).otherwise(start), F.lit(0))
    size = F.when(length < 0, n - at + length + 1).otherwise(length)
    return F.when((size <= 0) | (at >= n), F.lit("")).otherwise(F.substring(s, at + 1, size))


def replace_text(s, old: str, new: str, ignore_case: bool = False) -> Column:
    if not ignore_case:
        return F.replace(col(s), F.lit(old), F.lit(new))
    literal = "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in old)
    return F.regexp_replace(col(s), f"(?i){literal}", new.replace("\\", "\\\\").replace("$", "\\$"))


def find_text(s, part: str, start: int = 0) -> Column:
    """The first place of part at or after start, or -1."""
    return F.when(F.lit(start) > F.length(col(s)), F.lit(-1)).otherwise(F.locate(part, col(s), start + 1) - 1)


def code_at(s, k: int) -> Column:
    """The code point at k, 0 outside the string."""
    s = col(s)
    n = F.length(s)
    at = F.lit(k) + (n if k < 0 else F.lit(0))
    return F.when((at < 0) | (at >= n), F.lit(0)).otherwise(F.ascii(F.substring(s, at + 1, F.lit(1))))


def pad_to(s, width: int) -> Column:
    """Pads on the right to width, or on the left to -width; never cuts."""
    s = col(s)
    n = abs(width)
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, " ") if width > 0 else F.lpad(s, n, " "))


def same_prefix(a, b, n: int) -> Column:
    """Whether a and b agree in their first n characters, without regard to case."""
    return F.lower(F.substring(col(a), 1, n)) == F.lower(F.substring(col(b), 1, n))


def set_pair(s, key: str, value: str) -> Column:
    r"""s in the form \key\value\key\value with key set."""
    return pairs_text(F.map_concat(F.map_filter(pairs_of(s), lambda k, v: k != key), F.create_map(F.lit(key), F.lit(value))))


def pairs_of(s) -> Column:
    r"""A map from \key\value\key\value; an odd last key goes; of equal keys the first counts."""
    split = F.split(col(s), r"\\")
    parts = F.slice(split, F.lit(2), F.size(split))
    n = F.floor(F.size(parts) / 2).cast("int")
    keys = F.filter(F.slice(parts, 1, n * 2), lambda x, i: i % 2 == 0)
    values = F.filter(F.slice(parts, 1, n * 2), lambda x, i: i % 2 == 1)
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    firsts = F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.map_from_entries(firsts)


def pairs_text(m) -> Column:
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("\\"), e["key"], F.lit("\\"), e["value"])), "")


def get_pair(s, key: str) -> Column:
    """The value of key, empty where there is none."""
    return F.coalesce(F.try_element_at(pairs_of(s), F.lit(key)), F.lit(""))


def tokens(s) -> Column:
    """Words apart by white space; a double-quoted run is one word, without its quotes."""
    found = F.regexp_extract_all(col(s), F.lit(r'("[^"]*"|[^\s"]+)'), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, '^"|"$', ""))


def split_any(s, separators: list[str]) -> Column:
    """Fields between any of the separators, the longest first where several match."""
    longest = sorted(separators, key=len, reverse=True)
    return F.split(col(s), "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in x) for x in longest))


def first_word(s) -> Column:
    return F.element_at(F.split(col(s), " "), 1)


def other_words(s) -> Column:
    s = col(s)
    at = F.locate(" ", s)
    return F.when(at == 0, F.lit("")).otherwise(F.substring(s, at + 1, F.length(s)))


def first_words(s, n: int) -> Column:
    return F.array_join(F.slice(F.split(col(s), " "), 1, n), " ")


def percent_encode(s) -> Column:
    """Keeps letters, digits and - _ . ! ~ ' ( ); a space becomes %20."""
    out = F.url_encode(col(s))
    #: What url_encode writes, and what stands for it here.
    for was, now in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("*", "%2A")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def number_of(s) -> Column:
    """The number that s starts with, 0 where it starts with none."""
    return F.coalesce(F.regexp_extract(col(s), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def vector_text(v) -> Column:
    return F.concat(F.lit("'"), F.array_join(F.transform(col(v), lambda x: F.format_string("%.1f", x)), " "), F.lit("'"))


def vector_of(s) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(col(s)), "'", ""), r"\s+"), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def ordinal(n) -> Column:
    """1st, 2nd, 3rd, 11th."""
    n = col(n)
    ten, hundred = n % 10, n % 100
    teen = (hundred >= 11) & (hundred <= 13)
    return F.concat(n.cast("string"), F.when(~teen & (ten == 1), "st").when(~teen & (ten == 2), "nd").when(~teen & (ten == 3), "rd").otherwise("th"))


def clock_text(seconds) -> Column:
    """hh:mm:ss of whole seconds."""
    s = col(seconds).cast("long")
    return F.concat_ws(":", *[F.lpad(x.cast("long").cast("string"), 2, "0") for x in (F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)])


def wildcard(s, pattern: str) -> Column:
    """Whether s matches pattern as a whole; * is any run and ? any one character."""
    like = "".join({"*": "%", "?": "_"}.get(c, f"\\{c}" if c in "%_\\" else c) for c in pattern)
    return col(s).like(like)


def version_key(s) -> Column:
    """An array to compare versions by: numeric prefix of each dotted part, then its text without case; a part "git" is above all numbers."""
    def part(p):
        digits = F.regexp_extract(p, r"^\d+", 0)
        return F.struct(F.when(F.lower(p) == "git", F.lit(2**62)).otherwise(F.coalesce(digits.try_cast("long"), F.lit(-1))).alias("n"), F.lower(F.regexp_replace(p, r"^\d+", "")).alias("t"))

    return F.transform(F.split(col(s), r"\."), part)
