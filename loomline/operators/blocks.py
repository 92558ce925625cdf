"""Dense linear algebra on matrices of blocks, rows (i, j, block) with a block's numbers row by row, and on tall matrices, a row each.

A product joins blocks on the inner index, multiplies in numpy and adds up by place: each task adds what it makes for a place before
anything is shuffled, so a long inner side sends one block per place and task. Blocks have SIZE rows and columns; missing ones are
zero. Factors of a tall matrix of d columns are made of d by d pieces, combined FAN at a time, so no task holds more than FAN of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import written

SIZE, FAN = 64, 16
#: Places for which a task holds sums before it hands them on.
HELD = 256
_SCHEMA = "i long, j long, block array<double>"


def _table(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    i, j, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array([x.ravel() for x in b], pa.list_(pa.float64()))], names=["i", "j", "block"])


def _numpy(batch: pa.RecordBatch, c: str, size: int) -> np.ndarray:
    return batch[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)


def _added(size: int):
    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, block in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), _numpy(batch, "block", size)):
                sums[i, j] = sums[i, j] + block if (i, j) in sums else block
            if len(sums) > HELD:
                yield _table([(*k, x) for k, x in sums.items()])
                sums = {}
        yield _table([(*k, x) for k, x in sums.items()])

    return run


def added(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of one place added up: first in the tasks where they are, then those of a place in one task."""
    some = blocks.select("i", "j", "block").mapInArrow(_added(size), _SCHEMA)

    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(_numpy(b, "block", size).sum(0) for b in table.to_batches())
        return pa.Table.from_batches([_table([(key[0].as_py(), key[1].as_py(), total)])])

    return some.groupBy("i", "j").applyInArrow(whole, _SCHEMA)


def to_blocks(entries: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of a matrix given as rows (i, j, value); entries of one place add up, those with a null are left out."""
    rows = entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value")).dropna()
    rows = rows.groupBy("i", "j").agg(F.sum("value").alias("value"))
    placed = rows.select(F.expr(f"i div {size}").alias("i"), F.expr(f"j div {size}").alias("j"), (F.col("i") % size * size + F.col("j") % size).cast("int").alias("at"), "value")

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:  # at most size * size entries
        block = np.zeros(size * size)
        block[table["at"].to_numpy()] = table["value"].to_numpy()
        return pa.Table.from_batches([_table([(key[0].as_py(), key[1].as_py(), block)])])

    return placed.groupBy("i", "j").applyInArrow(fill, _SCHEMA)


def to_entries(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (i, j, value) of the entries that are not zero."""
    rows = blocks.select("i", "j", F.posexplode("block").alias("at", "value")).where("value <> 0")
    return rows.select((F.col("i") * size + F.expr(f"at div {size}")).alias("i"), (F.col("j") * size + F.col("at") % size).alias("j"), "value")


def product(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """The blocks of the product of two matrices of blocks."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("block").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("block").alias("y"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                yield _table(list(zip(some["i"].to_pylist(), some["j"].to_pylist(), np.matmul(_numpy(some, "x", size), _numpy(some, "y", size)))))

    return added(left.join(right, "k").select("i", "j", "x", "y").mapInArrow(run, _SCHEMA), size)


def combined(a: DataFrame, b: DataFrame, wa: float, wb: float, size: int = SIZE) -> DataFrame:
    """wa times one matrix of blocks and wb times another, added."""
    scaled = lambda m, w: m.select("i", "j", F.transform("block", lambda x: x * w).alias("block"))
    return added(scaled(a, wa).unionByName(scaled(b, wb)), size)


def identity(spark, n: int, size: int = SIZE) -> DataFrame:
    """The identity of n rows; past them, a block is zero."""
    rows = spark.range(-(-n // size)).select(F.col("id").alias("i"), F.col("id").alias("j"))
    return rows.withColumn("block", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: ((k % (size + 1) == 0) & (F.col("i") * size + F.floor(k / (size + 1)) < n)).cast("double")))


def norm(a: DataFrame) -> float:
    """The root of the sum of squares: one number for the driver."""
    return float(a.agg(F.coalesce(F.sum(F.aggregate("block", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))).first()[0]) ** 0.5


def inverse_root(a: DataFrame, n: int, rounds: int = 60, close: float = 1e-13, size: int = SIZE) -> DataFrame:
    """The inverse square root of a symmetric positive definite matrix of n rows, by Newton-Schulz rounds of products; raises where they do not settle."""
    c = norm(a)
    one = written(identity(a.sparkSession, n, size), "identity")
    y, z = written(combined(a, one, 1 / c, 0.0, size), "schulz"), one
    last = None
    for _ in range(rounds):
        zy = written(product(z, y, size), "schulz")
        off = norm(combined(one, zy, 1.0, -1.0, size))
        if off < close * n or (last is not None and off < 1e-8 and off >= last):
            return combined(z, one, c**-0.5, 0.0, size)
        t = written(combined(one, zy, 1.5, -0.5, size), "schulz")
        y, z, last = written(product(y, t, size), "schulz"), written(product(t, z, size), "schulz"), off
    raise ValueError("the matrix is not positive definite, or too near to one that is not")


def exponential(a: DataFrame, n: int, terms: int = 14, size: int = SIZE) -> DataFrame:
    """The matrix exponential of a square matrix of n rows: scaled down until its norm is under a half, a series, and as many squarings."""
    squarings = max(0, int(np.ceil(np.log2(max(norm(a), 1e-300)))) + 1)
    one = written(identity(a.sparkSession, n, size), "identity")
    small = written(combined(a, one, 0.5**squarings, 0.0, size), "scaled")
    out = one
    for k in range(terms, 0, -1):  # 1 + a/1 (1 + a/2 (1 + ...))
        out = written(combined(one, product(small, out, size), 1.0, 1.0 / k, size), "series")
    for _ in range(squarings):
        out = written(product(out, out, size), "squared")
    return out


def tall_r(rows: DataFrame, column: str) -> np.ndarray:
    """The d by d upper factor, of a diagonal that is not negative, of the QR of a tall matrix whose rows are arrays of d numbers; rows that are null, or hold one, are left out.

    Each task factors its own rows, FAN factors at a time become one, in rounds, and the last one, d by d, comes to the driver.
    """
    keep = F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull())

    def upper(x: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(x, mode="r")
        return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if len(r) == r.shape[1] else r

    def factor(batches):
        r = None
        for batch in batches:
            d = len(batch["x"][0]) if batch.num_rows else 0
            if d:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                r = upper(x if r is None else np.vstack([r, x]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["x"])

    made = written(rows.where(keep).select(F.col(column).cast("array<double>").alias("x")).mapInArrow(factor, "x array<double>"), "factors")
    parts = made.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        made = written(made.coalesce(parts).mapInArrow(factor, "x array<double>"), "factors")
    got = made.collect()  # d rows
    return upper(np.array([r.x for r in got])) if got else np.zeros((0, 0))


def orthonormal(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column replaced by its row of Q, so that columns are orthonormal and span what they spanned; raises where they depend on each other."""
    r = tall_r(rows, column)
    if not len(r) or len(r) < r.shape[1] or np.abs(np.diag(r)).min() < 1e-12 * np.abs(r).max():
        raise ValueError("columns depend on each other")
    inverse = np.linalg.inv(r)  # d by d

    @F.pandas_udf("array<double>")
    def q(x: pd.Series) -> pd.Series:
        known = [k for k, v in enumerate(x) if v is not None and not np.isnan(np.asarray(v, float)).any()]
        out: list = [None] * len(x)
        for k, v in zip(known, np.array([x.iloc[k] for k in known]).reshape(-1, len(r)) @ inverse):
            out[k] = v
        return pd.Series(out, dtype=object)

    return rows.withColumn(column, q(F.col(column).cast("array<double>")))


def least_squares(rows: DataFrame, column: str, target: str) -> tuple[np.ndarray, float]:
    """The weights, one per number of the column, of least squared error against the target, and that error: from the factor of both together."""
    r = tall_r(rows.select(F.when(F.col(target).isNotNull(), F.concat(F.col(column).cast("array<double>"), F.array(F.col(target).cast("double")))).alias("both")), "both")
    d = r.shape[1] - 1
    return np.linalg.lstsq(r[:, :d], r[:, d], rcond=None)[0], float(r[d, d] ** 2) if len(r) > d else 0.0


def singular_values(rows: DataFrame, column: str) -> np.ndarray:
    """The singular values of a tall matrix, greatest first."""
    r = tall_r(rows, column)
    return np.linalg.svd(r, compute_uv=False) if len(r) else np.zeros(0)
