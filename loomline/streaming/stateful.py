"""Keyed state with eviction and timers, kept in Spark's state store: the latest producers of a node, and ballots that close by event time.

Both run on transformWithStateInPandas, which wants the RocksDB state store: start their streams inside rocksdb(spark).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, and run a batch without data where a new watermark calls for one; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _Recent(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "producer long", "at_us long")
        self.totals = handle.getValueState("totals", "held long, evicted long, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, evicted, late = self.totals.get() if self.totals.exists() else (0, 0, 0)
        for frame in rows:
            for producer, at in frame.sort_values(["at_us", "producer"], kind="stable")[["producer", "at_us"]].itertuples(index=False):
                producer, at = int(producer), int(at)
                if self.seen.containsKey((producer,)):
                    if at < self.seen.getValue((producer,))[0]:
                        late += 1
                    else:
                        self.seen.updateValue((producer,), (at,))
                    continue
                self.seen.updateValue((producer,), (at,))
                held += 1
                if held > self.most:
                    _, gone = min((v[0], k[0]) for k, v in self.seen.iterator())
                    self.seen.removeKey((gone,))
                    held, evicted = held - 1, evicted + 1
        self.totals.update((held, evicted, late))
        now = sorted(k[0] for k, _ in self.seen.iterator())
        yield pd.DataFrame({"node": [key[0]], "producers": [now], "evicted": [evicted], "late": [late]})

    def close(self) -> None:
        pass


def recent_producers(stream: DataFrame, node: str, producer: str, at: str, most: int) -> DataFrame:
    """(node, producers, evicted, late) of a stream in update mode: which `most` producers of a node were seen last, how often one had to go, how many
    records were older than what their producer had sent before.

    A producer that is seen again moves up; equal times count as seen again. When there is one too many, the one that was
    seen longest ago goes, the least of equals. So the producers that are held do not depend on the order of arrival, and state is `most` rows a node; counts do depend on it.
    Rows that lack a node, a producer or a time are left out.
    """
    rows = stream.select(F.col(node).cast("long").alias("node"), F.col(producer).cast("long").alias("producer"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us")).dropna()
    return rows.groupBy("node").transformWithStateInPandas(_Recent(most), "node long, producers array<long>, evicted long, late long", "Update", "None")


class _Ballots(StatefulProcessor):
    def __init__(self, seconds: int):
        self.length = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.votes = handle.getMapState("votes", "end_ms long, voter long", "at_us long, choice string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, closed = set(), timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame = frame.assign(end_ms=(frame["at_us"] // (1000 * self.length) + 1) * self.length)
            last = frame[frame["end_ms"] > closed].sort_values(["at_us", "choice"]).groupby(["end_ms", "voter"]).tail(1)  # a vote for a closed ballot is late
            for end, voter, at, choice in last[["end_ms", "voter", "at_us", "choice"]].itertuples(index=False):
                place, vote = (int(end), int(voter)), (int(at), str(choice))
                if not self.votes.containsKey(place) or tuple(self.votes.getValue(place)) < vote:
                    self.votes.updateValue(place, vote)
                ends.add(int(end))
        for end in ends:
            self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        own = [(tuple(k), tuple(v)) for k, v in self.votes.iterator() if k[0] == end]
        for place, _ in own:
            self.votes.removeKey(place)
        count = Counter(choice for _, (_, choice) in own)
        best = min(count, key=lambda c: (-count[c], c), default=None)
        if best is not None:
            yield pd.DataFrame({"ballot": [key[0]], "end_ms": [end], "voters": [len(own)], "choice": [best], "votes": [count[best]]})

    def close(self) -> None:
        pass


def ballots(stream: DataFrame, ballot: str, voter: str, choice: str, at: str, seconds: int, late: str) -> DataFrame:
    """(ballot, end_ms, voters, choice, votes) of a stream in append mode: each ballot's windows of `seconds`, as event time closes them.

    A voter's last vote in a window counts, of equal times the greater choice; most votes win, of equals the least choice. A window closes, once, when the
    watermark, `late` behind the latest time, has passed its end; its votes leave the state then, and votes for it that come afterwards are dropped.
    Rows that lack a ballot, a voter, a choice or a time are left out.
    """
    rows = stream.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    rows = rows.select(F.col(ballot).cast("long").alias("ballot"), F.col(voter).cast("long").alias("voter"), F.col(choice).cast("string").alias("choice"), F.unix_micros("event_time").alias("at_us"), "event_time").dropna()
    return rows.groupBy("ballot").transformWithStateInPandas(_Ballots(seconds), "ballot long, end_ms long, voters long, choice string, votes long", "Append", "EventTime")
