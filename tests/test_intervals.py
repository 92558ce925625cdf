"""Interval sets against plain counting of points."""

import random

import pytest

from loomline.operators import intervals

CELLS = 60


def rows_of(seed):
    rnd = random.Random(seed)
    out = [("hot" if rnd.random() < 0.7 else rnd.choice("ab"), rnd.randrange(CELLS - 6), rnd.randrange(1, 7)) for _ in range(40)]
    return [(k, s, s + n) for k, s, n in out] + [("a", 5, 5), ("a", 9, 4), (None, 1, 9), ("b", None, 9), ("b", 3, None), ("hot", 10, 20), ("hot", 20, 25), ("hot", 12, 14), ("hot", 10, 20)]


def frame(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id long, key string, s long, e long")


def cells(rows, key):
    return {c for k, s, e in rows if k == key and s is not None and e is not None for c in range(s, e)}


def runs(points):
    out = []
    for c in sorted(points):
        if out and out[-1][1] == c:
            out[-1][1] = c + 1
        else:
            out.append([c, c + 1])
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def sides():
    return rows_of(1)[:35] + [("none", 3, 9)], rows_of(2)[:20] + rows_of(2)[-9:], rows_of(3)[:12]


def test_union(spark, sides):
    got = intervals.union_of(frame(spark, sides[1]), "key", "s", "e").collect()
    want = [(k, *r) for k in ("a", "b", "hot") for r in runs(cells(sides[1], k))]
    assert sorted((r.key, r.start, r.end) for r in got) == want
    assert [(r.key, r.start, r.end) for r in sorted(got, key=lambda r: r.number)] == want and sorted(r.number for r in got) == list(range(1, len(want) + 1))


def test_pieces(spark, sides):
    seg, cover, floors = sides
    args = (frame(spark, seg), frame(spark, cover).drop("id"))
    pieces = lambda keep: sorted((n, k, *r) for n, (k, s, e) in enumerate(seg) if k and s is not None and e is not None for r in runs({c for c in range(s, e) if keep(k, c)}))
    known = {k: cells(cover, k) for k in ("a", "b", "hot", "none")}
    under = {k: cells(floors, k) for k in known}
    assert sorted(map(tuple, intervals.covered(*args, "id", "key", "s", "e").collect())) == pieces(lambda k, c: c in known[k])
    assert sorted(map(tuple, intervals.uncovered(*args, "id", "key", "s", "e").collect())) == pieces(lambda k, c: c not in known[k])
    assert sorted(map(tuple, intervals.supported(*args, frame(spark, floors).drop("id"), "id", "key", "s", "e").collect())) == pieces(lambda k, c: c in known[k] and c in under[k])


def test_pair_counts(spark, sides):
    a, b, _ = sides
    real = lambda rows: [r for r in rows if None not in r]
    half = sum(k == j and max(s, t) < min(e, f) and s < e and t < f for k, s, e in real(a) for j, t, f in real(b))
    shut = sum(k == j and max(s, t) <= min(e, f) and s <= e and t <= f for k, s, e in real(a) for j, t, f in real(b))
    assert intervals.pair_count(frame(spark, a), frame(spark, b), "s", "e", "key").first().pairs == half
    assert intervals.pair_count(frame(spark, a), frame(spark, b), "s", "e", "key", closed=True).first().pairs == shut


def test_empty(spark):
    none, some = frame(spark, []), frame(spark, [("a", 1, 4)])
    assert intervals.union_of(none, "key", "s", "e").collect() == []
    assert intervals.covered(none, some, "id", "key", "s", "e").collect() == [] == intervals.covered(some, none, "id", "key", "s", "e").collect()
    assert [tuple(r) for r in intervals.uncovered(some, none, "id", "key", "s", "e").collect()] == [(0, "a", 1, 4)]
    assert intervals.pair_count(none, some, "s", "e").first().pairs == 0


def test_one_key_is_dealt_over_tasks(spark):
    from loomline.operators.windows import running_sums

    rows = spark.range(0, 4000).selectExpr("'hot' AS key", "id AS at", "1 AS one").repartition(4)
    told = running_sums(rows, ["key", "at"], ["one"])
    assert told.where("one_to <> at + 1").count() == 0
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # which joins small partitions
    spark.conf.set(merge, "false")
    held = rows.repartitionByRange("key", "at").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    spark.conf.unset(merge)
    assert len(held) > 1
