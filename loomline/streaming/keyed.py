"""Keyed state over records: latest wins, leases, gaps and rings, as batch plans and as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """The last record of each key; what arrives late but is older loses."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*at)).alias("r")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def leased(df: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    return df.where(F.col(at) >= now - F.make_interval(secs=F.lit(seconds)))


def gaps(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """df with missed (numbers left out since the record before in arrival order `at`) and reset (the number fell)."""
    before = F.lag(sequence).over(Window.partitionBy(*keys).orderBy("at"))
    return df.withColumn("missed", F.greatest(F.lit(0), F.coalesce(F.col(sequence) - before - 1, F.lit(0)))).withColumn("reset", F.coalesce(F.col(sequence) < before, F.lit(False)))


def ring(df: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """The last `keep` records of each key."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("back", back).where(F.col("back") <= keep).drop("back")


def stream_windows(stream: DataFrame, at: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """Counts and sums per key and event-time window of a stream. In append mode a window comes out once, when the watermark has passed it, and its state goes; complete mode keeps all windows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def stream_latest(stream: DataFrame, key: str, at: str, value: str, late: str = "1 hour") -> DataFrame:
    """(key, at, value) of a stream, a row whenever a key's record is newer than all before it; state is dropped after `late` without records.

    Keys are whole numbers, values doubles, and `at` a timestamp.
    """
    minutes = int(pd.Timedelta(late).total_seconds() * 1000)

    def step(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else (None, None)
        newest, fresh = best[0], None
        for frame in frames:
            if len(frame):
                row = frame.loc[frame["at"].idxmax()]
                us = int(row["at"].value // 1000)
                if newest is None or us > newest:
                    newest, fresh = us, float(row["value"])
        if fresh is not None:
            state.update((newest, fresh))
            yield pd.DataFrame({"key": [keys[0]], "at_us": [newest], "value": [fresh]})
        state.setTimeoutDuration(minutes)

    rows = stream.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, at_us long, value double", "at_us long, value double", "update", "ProcessingTimeTimeout")
