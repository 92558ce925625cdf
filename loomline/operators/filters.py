"""Row masks, flag and wildcard filters, cursors and ordered views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.strings import decolour

_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "!=": lambda a, b: a != b}


def number_test(field: str, op: str, value) -> Column:
    """Operators that make sense for text alone count as >=."""
    return _ORDER.get(op, _ORDER[">="])(F.col(field), F.lit(value))


def text_test(field: str, op: str, value: str) -> Column:
    """Without case and colour codes; an empty pattern is contained in nothing."""
    a, b = F.lower(decolour(field)), value.lower()
    has, starts = a.contains(b) if b else F.lit(False), a.startswith(b)
    tests = {"contains": has, "lacks": ~has, "starts": starts, "not starts": ~starts}
    if op not in tests and op not in _ORDER:
        raise ValueError(f"no such operator: {op}")
    return tests[op] if op in tests else _ORDER[op](a, F.lit(b))


def mask(df: DataFrame, tests: list[tuple[str, str, object]]) -> Column:
    """All of the tests (field, operator, value)."""
    kinds = dict(df.dtypes)
    return reduce(lambda a, b: a & b, [(text_test if kinds[f] == "string" else number_test)(f, o, v) for f, o, v in tests], F.lit(True))


def visible(df: DataFrame, all_of: list[list], any_of: list[list]) -> DataFrame:
    """Rows that pass every mask of all_of and, if there are any in any_of, one of those."""
    every = reduce(lambda a, b: a & b, [mask(df, m) for m in all_of], F.lit(True))
    some = reduce(lambda a, b: a | b, [mask(df, m) for m in any_of]) if any_of else F.lit(True)
    return df.where(every & some)


def by_flags(df: DataFrame, field: str, any_of: int = 0, all_of: int = 0, none_of: int = 0) -> DataFrame:
    f = F.col(field)
    out = df
    if any_of:
        out = out.where(f.bitwiseAND(F.lit(any_of)) != 0)
    return out.where((f.bitwiseAND(F.lit(all_of)) == all_of) & (f.bitwiseAND(F.lit(none_of)) == 0))


def next_match(df: DataFrame, id_col: str, after, found: Column) -> DataFrame:
    """The first row after an id for which found holds."""
    return df.where(found & (F.col(id_col) > after)).orderBy(id_col).limit(1)


def chain(df: DataFrame, id_col: str, found: Column) -> DataFrame:
    """All rows for which found holds, last id first."""
    return df.where(found).orderBy(F.desc(id_col))


def within_radius(df: DataFrame, fields: list[str], centre: list[float], radius: float) -> DataFrame:
    """A box first, which reaches the scan as a pushed filter, then the distance."""
    box = reduce(lambda a, b: a & b, [F.col(f).between(c - radius, c + radius) for f, c in zip(fields, centre)])
    dist2 = sum(((F.col(f) - c) * (F.col(f) - c) for f, c in zip(fields, centre)), F.lit(0.0))
    return df.where(box & (dist2 <= radius * radius))


def lookup_by_prefix(df: DataFrame, field: str, text: str) -> DataFrame:
    """The row whose field is text without case; else the only one with that prefix; else none."""
    low = F.lower(field)
    near = df.where(low.startswith(text.lower())).withColumn("exact", (low == text.lower()).cast("int"))
    top = near.agg(F.max("exact").alias("best"), F.count("*").alias("n"))
    return near.crossJoin(F.broadcast(top)).where((F.col("exact") == F.col("best")) & ((F.col("best") == 1) | (F.col("n") == 1))).drop("exact", "best", "n")
