"""Folds over ordered rows that split over tasks, since their steps combine: least squares with forgetting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import written


def _state(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array(table["a"][0].as_py()).reshape(d, d), np.array(table["b"][0].as_py())


def recursive_least_squares(df: DataFrame, key: str, order: list[str], x: list[str], y: str, forget: float, prior: float = 1e3) -> DataFrame:
    """(key, *order, theta, error) of every row: the weights of x, and of a constant, after this row, and how far the weights before it missed y.

    Of rows `forget` is how much of the past is kept from one row to the next; a key starts from weights of 0 with a variance of `prior`. Between two rows the fold
    keeps A = forget * A + x x' and b = forget * b + x y, and a run of n rows does to them what one matrix step does, so runs combine: rows are
    range-partitioned by key and order, each part is summed up, what comes before a part is combined over one row per part, and then every part folds its own rows. A key with
    most rows is many parts. Order has to tell a key's rows apart; rows with a null among key, order, x or y are left out.
    """
    d = len(x) + 1
    rows = df.select(F.col(key).alias("key"), *order, F.array(*[F.col(c).cast("double") for c in x], F.lit(1.0)).alias("x"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(x)])
    rows = rows.dropna().select("key", *order, "x", "y")
    rows = written(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "fold")
    keys = [(c, "ascending") for c in order]
    kind = rows.schema["key"].dataType.simpleString()

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.array(table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, d), table["y"].to_numpy()

    def total(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        xs, ys = arrays(table.sort_by(keys))
        decay = forget ** np.arange(len(ys) - 1, -1, -1.0)
        return pa.table({"key": [k[0].as_py()], "part": pa.array([k[1].as_py()], pa.int32()), "n": [len(ys)], "a": [((xs * decay[:, None]).T @ xs).ravel().tolist()], "b": [((xs * decay[:, None]).T @ ys).tolist()]})

    def before(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, out = np.eye(d) / prior, np.zeros(d), []
        for r in table.sort_by("part").to_pylist():
            out.append({"key": k[0].as_py(), "part": r["part"], "a": a.ravel().tolist(), "b": b.tolist()})
            a, b = forget ** r["n"] * a + np.array(r["a"]).reshape(d, d), forget ** r["n"] * b + np.array(r["b"])
        return pa.Table.from_pylist(out, pa.schema([("key", table["key"].type), ("part", pa.int32()), ("a", pa.list_(pa.float64())), ("b", pa.list_(pa.float64()))]))

    def fold(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by(keys)
        xs, ys = arrays(table)
        a, b = _state(start, d)
        theta, missed, now = np.empty((len(ys), d)), np.empty(len(ys)), np.linalg.solve(a, b)
        for at in range(0, len(ys), 4096):
            some = slice(at, at + 4096)
            many_a, many_b = np.empty((len(ys[some]), d, d)), np.empty((len(ys[some]), d, 1))
            for k, (u, v) in enumerate(zip(xs[some], ys[some])):
                a = forget * a + np.outer(u, u)
                b = forget * b + u * v
                many_a[k], many_b[k, :, 0] = a, b
            theta[some] = np.linalg.solve(many_a, many_b)[:, :, 0]
            earlier = np.vstack([now[None], theta[some][:-1]])
            missed[some] = ys[some] - (earlier * xs[some]).sum(1)
            now = theta[some][-1]
        own = table.select(["key", *order])
        return own.append_column("theta", pa.array(theta.tolist(), pa.list_(pa.float64()))).append_column("error", pa.array(missed))

    parts = rows.groupBy("key", "part").applyInArrow(total, f"key {kind}, part int, n long, a array<double>, b array<double>")
    starts = written(parts.groupBy("key").applyInArrow(before, f"key {kind}, part int, a array<double>, b array<double>"), "fold-starts")
    schema = ", ".join([f"key {kind}", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in order], "theta array<double>", "error double"])
    return rows.groupBy("key", "part").cogroup(starts.groupBy("key", "part")).applyInArrow(fold, schema)
