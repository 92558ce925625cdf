import random

import pytest

from loomline.sources import sinks
from loomline.operators import graphs, joins


def test_walks_end_or_raise(spark):
    edges = spark.createDataFrame([(k, k + 1, 0.5) for k in range(6)], "src long, dst long, weight double")
    source = spark.range(1).withColumnRenamed("id", "node")
    assert {r.node: r.level for r in graphs.bfs(edges, source).collect()} == {k: k for k in range(7)}
    assert {r.node: r.dist for r in graphs.shortest_paths(edges, 0).collect()} == {k: k / 2 for k in range(7)}
    assert graphs.bfs(edges, source, most=6).count() == graphs.shortest_paths(edges, 0, most=6).count() == 7
    with pytest.raises(ValueError):
        graphs.bfs(edges, source, most=3)
    with pytest.raises(ValueError):
        graphs.shortest_paths(edges, 0, most=3)


def test_nearest_takes_any_number_of_queries(spark):
    points = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(5)], "id long, v array<double>")
    queries = spark.range(5003).selectExpr("id", "array(double(id % 5), 1.0D) AS v")
    got = {(r.query, r.id, r.dist2) for r in joins.nearest(queries, points, 1).collect()}
    assert got == {(q, q % 5, 1.0) for q in range(5003)}


def test_a_sparse_matrix_can_be_read_back(spark):
    rows = [(0, 4, 1.5), (4, 0, 2.0), (2, 2, -1.0)]
    lines = [r.value for r in sinks.matrix_market_lines(spark.createDataFrame(rows, "src long, dst long, weight double")).collect()]
    assert lines[0] == "%%MatrixMarket matrix coordinate real general"
    n, m, many = map(int, lines[1].split())
    entries = [(int(a), int(b), float(w)) for a, b, w in map(str.split, lines[2:])]
    assert (n, m, many) == (5, 5, len(rows)) and all(1 <= a <= n and 1 <= b <= m for a, b, _ in entries)
    assert sorted((a - 1, b - 1, w) for a, b, w in entries) == sorted(rows)
    none = sinks.matrix_market_lines(spark.createDataFrame([], "src long, dst long, weight double"))
    assert [r.value for r in none.collect()][1] == "0 0 0"


def test_closure_joins_no_pair_again(spark, monkeypatch):
    rnd = random.Random(11)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)] + [(k, k + 1) for k in range(100, 180)] + [(7, 7), (200, 201), (201, 202), (202, 200), (None, 5), (3, None)]
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want if b is not None for c, d in edges if b == c}
        if more == want:
            break
        want = more
    told, path = [], graphs.scratch
    monkeypatch.setattr(graphs, "scratch", lambda s, label: told.append(path(s, label)) or told[-1])
    got = [tuple(r) for r in graphs.closure(spark.createDataFrame(edges, "src long, dst long")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert sum(spark.read.parquet(x).count() for x in told) == len(want)  # each pair is written once


def test_nearest_compares_in_products_of_matrices(spark, monkeypatch):
    monkeypatch.setattr(joins, "QUERIES", 7)
    rnd = random.Random(5)
    points = [(k, [rnd.choice([0.1, 0.2, 0.7, 1e4]) for _ in range(6)]) for k in range(900)] + [(k + 1000, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) for k in range(30)]
    odd = [(2000, None), (2001, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (2002, [float("nan")] * 6)]
    df = spark.createDataFrame(points + odd, "id long, v array<float>").repartition(3)
    queries = df.where("id % 50 = 0 OR id = 2001")
    plain = {tuple(r) for r in joins._nearest(queries, df, 5).collect()}
    monkeypatch.setattr(joins, "_nearest", lambda q, p, k, f=joins._nearest: f(q.where("id = 2001 OR id = 2000"), p, k))  # only for what is not finite
    got = [tuple(r) for r in joins.nearest(queries, df, 5).collect()]
    assert set(got) == plain and len(got) == len(plain) == 5 * queries.count()


def test_interval_join_leaves_out_what_nothing_can_meet(spark):
    rnd = random.Random(2)
    near = [(k, k % 3, s := rnd.randrange(100), s + rnd.randrange(12)) for k in range(60)]
    left = spark.createDataFrame(near + [(k, 0, 5000 + k, 5009 + k) for k in range(100, 400)] + [(999, 1, None, 4)], "a long, k long, s long, e long")
    right = spark.createDataFrame([(b, k, s + 3, e + 3) for b, k, s, e in near], "b long, k long, s2 long, e2 long")
    both = joins.interval_join(left, right, "s", "e", "s2", "e2", 16, ["k"])
    want = sorted((x[0], y[0]) for x in near for y in near if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] + 3 and y[2] + 3 < x[3])
    assert sorted((r.a, r.b) for r in both.collect()) == want
    last = max(e + 3 for _, _, s, e in near if s < e)
    assert f"< {last})" in both._jdf.queryExecution().optimizedPlan().toString() and "BroadcastHashJoin" not in both._jdf.queryExecution().toString()
    assert joins.interval_join(left, right.where("false"), "s", "e", "s2", "e2", 16, ["k"]).count() == 0
