"""Graph and tree operators against plain searches on small random graphs."""

import random
from collections import defaultdict

import pytest

from loomline.operators import graphs, trees


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")


def weighted(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def reach(pairs):
    to = defaultdict(set)
    for a, b in pairs:
        to[a].add(b)
    out = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            for w in to[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        out[a] = seen
    return out


def low_links(pairs):
    """Blocks and bridges by one depth-first search per component, parallel edges told apart."""
    near = defaultdict(list)
    for k, (a, b) in enumerate(pairs):
        near[a].append((b, k))
        near[b].append((a, k))
    number, low, stack, blocks, bridges = {}, {}, [], [], set()

    def visit(v, by):
        number[v] = low[v] = len(number)
        for w, k in near[v]:
            if k == by or w == v:
                continue
            if w not in number:
                stack.append(k)
                visit(w, k)
                low[v] = min(low[v], low[w])
                if low[w] >= number[v]:
                    block = set()
                    while not block or k not in block:
                        block.add(stack.pop())
                    blocks.append(block)
                    if len(block) == 1:
                        bridges.add(k)
            elif number[w] < number[v]:
                stack.append(k)
                low[v] = min(low[v], number[w])

    for v in list(near):
        if v not in number:
            visit(v, None)
    return [{tuple(sorted(pairs[k])) for k in b} for b in blocks], {tuple(sorted(pairs[k])) for k in bridges}


def random_graph(seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    pairs += [(100 + k, 101 + k) for k in range(25)] + [(100, 110), (118, 125), (118, 125)]  # a path with two rings, one of them a doubled edge
    pairs += [(200, 201 + k) for k in range(20)] + [(210, 211), (300, 300), (301, 301), (301, 302)]  # a star with a chord, and loops
    return pairs + [(b, a) for a, b in pairs[:3]]


@pytest.mark.parametrize("seed", [1])
def test_blocks_bridges_and_joints(spark, seed, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 8)
    pairs = random_graph(seed)
    got = trees.biconnected(edges_of(spark, [*pairs, (None, 4), (5, None)]))
    rows = got.collect()
    blocks, bridges = low_links(pairs)
    mine = defaultdict(set)
    for r in rows:
        mine[r.block].add((r.src, r.dst))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, blocks))
    assert {(r.src, r.dst) for r in rows if r.bridge} == bridges
    held = defaultdict(int)
    for b in blocks:
        for v in {x for e in b for x in e}:
            held[v] += 1
    assert {r.node: r.blocks for r in trees.joints(got).collect()} == {v: n for v, n in held.items() if n > 1}


def test_no_edges(spark):
    none = edges_of(spark, [])
    assert trees.biconnected(none).collect() == [] and trees.tree_order(none.toDF("node", "parent")).collect() == []
    assert graphs.components(none).collect() == [] and graphs.strong_components(none).collect() == [] and graphs.levels(none).collect() == []
    assert [tuple(r) for r in graphs.components(edges_of(spark, [(4, 4)])).collect()] == [(4, 4)]


def plain_order(parent):
    below, out = defaultdict(list), {}
    for v in sorted(parent):
        below[parent[v]].append(v)
    pre = post = 0
    todo = [(r, 0, False) for r in reversed(below[None])]
    while todo:
        v, depth, done = todo.pop()
        if done:
            out[v] += [post, depth, pre - out[v][0]]
            post += 1
            continue
        out[v] = [pre]
        pre += 1
        todo.append((v, depth, True))
        todo += [(w, depth + 1, False) for w in reversed(below[v])]
    return {v: (parent[v], *x) for v, x in out.items()}


def test_tree_order(spark):
    rnd = random.Random(5)
    parent = {v: rnd.choice([None, *range(v)]) if v % 9 == 0 else rnd.randrange(v) for v in range(1, 80)} | {0: None}
    parent |= {1000 - k: 1001 - k if k else None for k in range(200)}  # a path, downwards
    rows = [(v, p) for v, p in parent.items() if p is not None or v not in (0, 1000)]
    rows += [(v, None) for v, p in parent.items() if p is None and v not in {q for q in parent.values()}]
    order = trees.tree_order(spark.createDataFrame([*rows, rows[0]], "node long, parent long"))
    got = {r.node: tuple(r)[1:] for r in order.collect()}
    assert got == plain_order(parent)
    pairs = [(rnd.choice(list(parent)), rnd.choice(list(parent))) for _ in range(200)] + [(5, 5), (None, 5), (77777, 5), (1000, 801), (801, 1000)]
    up = lambda v: [] if v is None else [v, *up(parent[v])]
    told = trees.with_ancestry(spark.createDataFrame(pairs, "a long, b long"), order).collect()
    assert sorted(map(repr, map(tuple, told))) == sorted(repr((a, b, None if a is None or a not in parent else a in up(b))) for a, b in pairs)


@pytest.mark.parametrize("rows", [[(1, 2), (2, 3), (3, 1)], [(1, 1)], [(1, 2), (1, 3)], [(4, None), (1, 2), (2, 1)]])
def test_no_tree(spark, rows):
    with pytest.raises(ValueError):
        trees.tree_order(spark.createDataFrame(rows, "node long, parent long"))


def test_strong_components(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randrange(50), rnd.randrange(50)) for _ in range(70)] + [(100 + k, 101 + k) for k in range(12)] + [(112, 105), (7, 7)]
    to = reach(pairs)
    want = {v: min([v, *(w for w in to[v] if v in to[w])]) for v in to}
    assert {r.node: r.component for r in graphs.strong_components(edges_of(spark, pairs)).collect()} == want


def test_levels_and_redundant_edges(spark):
    rnd = random.Random(7)
    pairs = sorted({tuple(sorted(rnd.sample(range(25), 2))) for _ in range(60)} | {(30 + k, 31 + k) for k in range(15)} | {(30, 45)})
    level = {}
    for v in sorted({x for p in pairs for x in p}):
        level[v] = max([level[a] + 1 for a, b in pairs if b == v], default=0)
    assert {r.node: r.level for r in graphs.levels(edges_of(spark, pairs)).collect()} == level
    to = reach(pairs)
    want = {(a, b) for a, b in pairs if any(b in to[m] for x, m in pairs if x == a and m != b)}
    assert {tuple(r) for r in graphs.redundant_edges(edges_of(spark, pairs)).collect()} == want and (30, 45) in want
    with pytest.raises(ValueError):
        graphs.levels(edges_of(spark, [(1, 2), (2, 3), (3, 2)]))


def test_eliminated_through_chains(spark):
    rnd = random.Random(8)
    rows = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (3, 2, 0.0), (1, 4, 9.0), (4, 2, 1.0)] + [(rnd.randrange(10, 30), rnd.randrange(10, 30), float(rnd.randrange(9))) for _ in range(70)]
    gone = {2, 3, *range(10, 22)}
    dist = {}
    for a, b, w in rows:
        dist[a, b] = min(w, dist.get((a, b), 99.0))
    for m in gone:
        for (a, x), w in list(dist.items()):
            for (y, b), w2 in list(dist.items()):
                if x == m == y and w + w2 < dist.get((a, b), 99.0):
                    dist[a, b] = w + w2
    want = {k: w for k, w in dist.items() if not gone & {*k} and k[0] != k[1]}
    got = graphs.without_nodes(weighted(spark, rows), spark.createDataFrame([(g,) for g in gone], "node long"))
    assert {(r.src, r.dst): r.weight for r in got.collect()} == want and want[1, 4] == 6.0


def test_searches(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)]
    got = graphs.bfs(edges_of(spark, pairs), spark.createDataFrame([(0,), (5,)], "node long"))
    assert {r.node: r.level for r in got.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 5: 0, 6: 1}
    far = graphs.shortest_paths(weighted(spark, [(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 0.0)]), 0)
    assert {r.node: r.dist for r in far.collect()} == {0: 0.0, 1: 2.0, 2: 1.0, 3: 2.0}
    with pytest.raises(ValueError):
        graphs.bfs(edges_of(spark, pairs), spark.range(1).toDF("node"), most=2)


def test_lists(spark):
    rows = [(k, k + 1 if k % 10 != 9 else None, 1, k) for k in range(40)]
    got = trees.list_ranks(spark.createDataFrame(rows, "id long, to long, one int, own int"), ["one", "own"])
    assert {tuple(r) for r in got.select("id", "last", "one", "own").collect()} == {(k, k // 10 * 10 + 9, 10 - k % 10, sum(range(k, k // 10 * 10 + 10))) for k in range(40)}
    with pytest.raises(ValueError):
        trees.list_ranks(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, to long, one int"), ["one"])


def test_a_forest_is_rooted_and_numbered_by_one_tour(spark, monkeypatch):
    ranked, ranks = [], trees.list_ranks
    monkeypatch.setattr(trees, "list_ranks", lambda *a: ranked.append(1) or ranks(*a))
    forest = [(1, 2), (1, 3), (3, 4), (3, 9), (9, 5), (20, 30), (30, 25), (7, 8)]
    rows = {r.node: r for r in trees.rooted(edges_of(spark, forest)).collect()}
    assert {n: r.parent for n, r in rows.items()} == {1: None, 2: 1, 3: 1, 4: 3, 9: 3, 5: 9, 20: None, 30: 20, 25: 30, 7: None, 8: 7}
    assert sorted(r.pre for r in rows.values()) == list(range(11)) and len(ranked) == 1
    for n, r in rows.items():
        below = {m for m in rows if m == n}
        while True:
            more = below | {m for m in rows if rows[m].parent in below}
            if more == below:
                break
            below = more
        assert sorted(rows[m].pre for m in below) == list(range(r.pre, r.pre + r.size)), n
