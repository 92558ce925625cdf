"""State with eviction and timers: replayed, late and equal-time input in several batches."""

from datetime import datetime, timedelta, timezone

import pytest

from loomline.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def runs(spark, tmp_path):
    def run(make, schema, batches, mode):
        """Each batch is a file; the stream is stopped and started again from its checkpoint for each."""
        out = []
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            got = []
            with stateful.rocksdb(spark):
                stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
                q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _, got=got: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
                q.awaitTermination(180)
                assert q.exception() is None
            out.append(sorted(got))
        return out

    return run


def test_recent_producers(spark, runs):
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [(1, 10, at(1)), (1, 11, at(2)), (1, 12, at(3)), (2, 10, at(1)), (None, 1, at(1)), (1, None, at(1))],
        [(1, 10, at(4)), (1, 13, at(5)), (1, 12, at(1))],  # 10 is seen again, so 11 goes; an older record of 12 is late
        [(1, 10, at(4)), (1, 13, at(5)), (2, 11, at(9)), (2, 12, at(9)), (2, 13, at(9))],  # replayed, and equal times
    ]
    got = runs(lambda s: stateful.recent_producers(s, "node", "producer", "at", 3), "node long, producer long, at timestamp", batches, "update")
    assert got == [[(1, [10, 11, 12], 0, 0), (2, [10], 0, 0)], [(1, [10, 12, 13], 1, 1)], [(1, [10, 12, 13], 1, 1), (2, [11, 12, 13], 1, 0)]]


def test_ballots_close_by_event_time(spark, runs):
    at = lambda s: START + timedelta(seconds=s)
    end = lambda n: int(START.timestamp() + 60 * n) * 1000
    batches = [
        [(1, 1, "a", at(5)), (1, 2, "b", at(6)), (1, 3, "b", at(7)), (1, 2, "a", at(8)), (1, 4, "c", at(9)), (1, 4, "b", at(9)), (2, 1, "x", at(30)), (2, None, "x", at(31))],
        [(1, 9, "c", at(65)), (1, 3, "c", at(2))],  # in the second window; an older vote of 3
        [(2, 1, "y", at(140))],  # closes the first window of both, and the second of 1
        [(1, 5, "a", at(10)), (1, 5, "a", at(135))],  # the first one is late: its window is closed
        [(3, 1, "z", at(400))],
    ]
    got = runs(lambda s: stateful.ballots(s, "ballot", "voter", "choice", "at", 60, "10 seconds"), "ballot long, voter long, choice string, at timestamp", batches, "append")
    flat = [r for rows in got for r in rows]
    assert sorted(flat) == [(1, end(1), 4, "a", 2), (1, end(2), 1, "c", 1), (1, end(3), 1, "a", 1), (2, end(1), 1, "x", 1), (2, end(3), 1, "y", 1)]
    assert got[0] == [] and len(flat) == len(set(flat))
