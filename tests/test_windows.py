"""Orders of keys that hold most rows, dealt over tasks, against plain sorting."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import matrices, windows


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [("hot" if rnd.random() < 0.8 else rnd.choice(["a", "b", None]), k, float(rnd.randrange(30)) if k % 11 else None) for k in range(240)]


@pytest.fixture
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, v double")


def by_key(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_ranks(frame, rows):
    want = {}
    for own in by_key(rows).values():
        for r in own:
            want[r[1]] = 1 + sum((x[2] is not None) > (r[2] is not None) or None not in (x[2], r[2]) and x[2] > r[2] for x in own)
    assert {r.id: r.place for r in windows.ranks(frame, ["key"], [F.col("v")], falling=True).collect()} == want


def test_strict_ranks(frame, rows):
    want = {}
    for own in by_key(rows).values():
        for k, r in enumerate(sorted(own, key=lambda r: (r[2] is not None, r[2] or 0, -r[1]))):
            want[r[1]] = k + 1
    assert {r.id: r.place for r in windows.strict_ranks(frame, ["key"], [F.asc("v"), F.desc("id")]).collect()} == want


def test_percentiles(frame, rows):
    got = {r.key: (r.p0, r.p1, r.p2) for r in windows.percentiles(frame, "key", "v", [0.5, 0.9, 1.0]).collect()}
    for key, own in by_key(rows).items():
        assert np.allclose(got[key], np.quantile([r[2] for r in own if r[2] is not None], [0.5, 0.9, 1.0]))


@pytest.mark.parametrize("bucket", [7, 1000])
def test_rolling_over_buckets(frame, rows, bucket):
    got = {r.id: (r.mean, r.variance) for r in windows.rolling_over(frame.where("v IS NOT NULL"), "v", ["key"], ["id"], 5, bucket).collect()}
    for own in by_key([r for r in rows if r[2] is not None]).values():
        for k, r in enumerate(own):
            last = [x[2] for x in own[max(0, k - 4) : k + 1]]
            assert np.allclose(got[r[1]], (np.mean(last), np.var(last)))
    assert len(got) == sum(r[2] is not None for r in rows)


def test_softmax(spark):
    rows = [("a", k, float(k)) for k in range(5)] + [(None, 9, 800.0), (None, 10, 799.0)]
    got = {r.id: r.weight for r in matrices.softmax_rows(spark.createDataFrame(rows, "key string, id long, v double"), "v", ["key"]).collect()}
    e = np.exp(np.arange(5.0) - 4)
    assert np.allclose([got[k] for k in range(5)], e / e.sum()) and np.allclose([got[9], got[10]], [1 / (1 + np.exp(-1)), 1 / (1 + np.exp(1))])


def test_empty(frame):
    none = frame.limit(0)
    assert windows.ranks(none, ["key"], [F.col("v")]).collect() == [] == windows.percentiles(none, "key", "v", [0.5]).collect()
    assert windows.rolling_over(none, "v", ["key"], ["id"], 3).collect() == [] == windows.strict_ranks(none, ["key"], ["id"]).collect()
