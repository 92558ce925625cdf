"""Arrays with holes (null slots), lists and key-value maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.strings import col


def implode(a, separator: str) -> Column:
    """Joins what is not null."""
    return F.array_join(col(a), separator)


def slot(a, k: int) -> Column:
    return F.get(col(a), F.lit(k))


def with_slot(a, k: int, value) -> Column:
    """Sets slot k, growing with nulls where needed."""
    a = col(a)
    grown = F.concat(a, F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(k + 1) - F.size(a), F.lit(0))))
    return F.transform(grown, lambda x, i: F.when(i == k, F.lit(value)).otherwise(x))


def add_free(a, value) -> Column:
    """Puts value in the first hole, else at the end."""
    a = col(a)
    hole = F.array_position(F.transform(a, lambda x: x.isNull()), F.lit(True)) - 1
    return F.when(hole >= 0, F.transform(a, lambda x, i: F.when(i == hole, F.lit(value)).otherwise(x))).otherwise(F.array_append(a, F.lit(value)))


def without_slot(a, k: int) -> Column:
    return F.transform(col(a), lambda x, i: F.when(i != k, x))


def push(a, value) -> Column:
    return F.array_append(col(a), F.lit(value))


def pop(a) -> Column:
    """All but the last."""
    return F.slice(col(a), 1, F.greatest(F.size(col(a)) - 1, F.lit(0)))


def shift(a) -> Column:
    """All but the first."""
    return F.slice(col(a), 2, F.greatest(F.size(col(a)) - 1, F.lit(0)))


def unshift(a, value) -> Column:
    return F.array_prepend(col(a), F.lit(value))


def sort_strings(a, prefix: int | None = None, descending: bool = False) -> Column:
    """Sorts by the first prefix characters, or the whole; nulls last."""
    key = (lambda x: F.substring(x, 1, prefix)) if prefix else (lambda x: x)
    down = -1 if descending else 1

    def compare(x, y):
        a, b = key(x), key(y)
        return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(a < b, -down).when(a > b, down).otherwise(0)

    return F.array_sort(col(a), compare)
