"""Arborescences, matchings, folds and random orders against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import counters
from loomline.operators import folds, optimal, windows


def least_weight(nodes, rows, root):
    """Of all choices of one entering edge per node, the least that has no cycle."""
    into = {v: [(w, a) for a, b, w in rows if b == v and a != v] for v in nodes}
    best = None
    for pick in itertools.product(*[into[v] for v in nodes]):
        up = {v: a for v, (_, a) in zip(nodes, pick)}

        def grounded(v, up=up):
            for _ in range(len(nodes) + 1):
                if v == root:
                    return True
                v = up.get(v)
                if v is None:
                    return False
            return False

        if all(map(grounded, nodes)):
            total = sum(w for w, _ in pick)
            best = total if best is None else min(best, total)
    return best


def test_arborescence(spark):
    rnd = random.Random(1)
    for n in (6, 7):
        rows = [(0, 1, 9.0), (0, n - 1, 8.0)] + [(a, a % (n - 1) + 1, 1.0) for a in range(1, n)] + [(a, b, float(rnd.randrange(1, 7))) for a in range(1, n) for b in range(1, n) if rnd.random() < 0.4]
        rows += [(3, 3, 0.0), (2, 0, 0.0), (0, 1, 11.0), (90, 91, 1.0), (91, 90, 1.0), (90, 1, 0.5)]
        got = optimal.arborescence(spark.createDataFrame([*rows, (None, 1, 0.0), (1, 2, None)], "src long, dst long, weight double"), 0).collect()
        nodes = list(range(1, n))
        told = {r.node: r for r in got}
        assert set(told) == {*nodes, 90, 91} and not told[90].reached and told[91].src is None
        reach = [r for r in rows if r[0] not in (90, 91)]
        assert sum(told[v].weight for v in nodes) == least_weight(nodes, reach, 0)
        assert all((told[v].src, v, told[v].weight) in rows for v in nodes)
        for v in nodes:
            for _ in range(n):
                v = told[v].src if v else 0
            assert v == 0


def test_nested_cycles(spark):
    rows = [(0, 1, 100.0), (1, 2, 1.0), (2, 1, 1.0), (2, 3, 2.0), (3, 4, 1.0), (4, 3, 1.0), (4, 1, 2.0), (4, 5, 3.0), (5, 2, 2.5), (0, 5, 90.0)]
    got = optimal.arborescence(spark.createDataFrame(rows, "src long, dst long, weight double"), 0).collect()
    assert sum(r.weight for r in got) == least_weight([1, 2, 3, 4, 5], rows, 0)


def greatest(rows):
    to, mate = {}, {}
    for a, b in rows:
        to.setdefault(a, set()).add(b)

    def place(a, seen):
        for b in to[a] - seen:
            seen.add(b)
            if b not in mate or place(mate[b], seen):
                mate[b] = a
                return True
        return False

    return sum(place(a, set()) for a in to)


def test_matching(spark):
    rnd = random.Random(2)
    for rows in ([(rnd.randrange(25), rnd.randrange(25)) for _ in range(45)], [(k, k + d) for k in range(12) for d in (0, 1)] + [(12, 0)], [(k, 0) for k in range(9)] + [(0, k) for k in range(9)]):
        got = [tuple(r) for r in optimal.matching(spark.createDataFrame([*rows, rows[0], (None, 1), (1, None)], "src long, dst long")).collect()]
        assert len(got) == greatest(rows) and set(got) <= set(rows)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
    assert optimal.matching(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_least_squares_with_forgetting(spark):
    rnd = random.Random(3)
    rows = [("hot" if k % 5 else "b", k, rnd.random() * 10, rnd.random() - 0.5, 0.0) for k in range(300)]
    rows = [(g, k, u, v, 2 * u - 3 * v + 1 + rnd.random()) for g, k, u, v, _ in rows]
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    got = folds.recursive_least_squares(spark.createDataFrame([*rows, ("b", 999, None, 1.0, 1.0), (None, 5, 1.0, 1.0, 1.0)], "g string, at long, u double, v double, y double"), "g", ["at"], ["u", "v"], "y", 0.95).collect()
    spark.conf.unset(merge)
    told = {(r.key, r["at"]): r for r in got}
    assert len(got) == len(rows)
    for g in ("hot", "b"):
        theta, p = np.zeros(3), np.eye(3) * 1e3
        for _, k, u, v, y in [r for r in rows if r[0] == g]:
            x = np.array([u, v, 1.0])
            error = y - theta @ x
            gain = p @ x / (0.95 + x @ p @ x)
            theta, p = theta + gain * error, (p - np.outer(gain, x @ p)) / 0.95
            assert np.allclose(told[g, k].theta, theta, atol=1e-9, rtol=1e-9) and abs(told[g, k].error - error) < 1e-8


#: Published answers of the generator with 20 rounds: counter, key, words.
VECTORS = [
    ([0] * 4, [0] * 4, [0x09218EBDE6C85537, 0x55941F5266D86105, 0x4BD25E16282434DC, 0xEE29EC846BD2E40B]),
    ([2**64 - 1] * 4, [2**64 - 1] * 4, [0x29C24097942BBA1B, 0x0371BBFB0F6F4E11, 0x3C231FFA33F83A1C, 0xCD29113FDE32D168]),
]


@pytest.mark.parametrize(("counter", "key", "words"), VECTORS)
def test_counter_vectors(spark, counter, key, words):
    got = spark.range(1).select(counters.threefry([F.lit(counters.signed(c)) for c in counter], tuple(key)).alias("w")).first().w
    assert [w % 2**64 for w in got] == words


def test_random_order_of_any_layout(spark):
    rows = spark.range(500)
    first = {r.id: r.place for r in windows.shuffled(rows.repartition(7), "id", (1, 2, 3, 4)).collect()}
    again = {r.id: r.place for r in windows.shuffled(rows.orderBy(F.desc("id")).coalesce(2), "id", (1, 2, 3, 4)).collect()}
    other = {r.id: r.place for r in windows.shuffled(rows, "id", (1, 2, 3, 4), draw=1).collect()}
    assert first == again != other and sorted(first.values()) == list(range(500)) == sorted(other.values())
    assert abs(np.corrcoef(list(first), list(first.values()))[0, 1]) < 0.2
