from collections import Counter

from tests.llm.helpers import documents, edge_rows

from loomline.llm import mixing, quality_rules
from loomline.llm.quality_rules import _measure


def test_measures_by_hand():
    eight = "a b c d e f g h"
    assert _measure("") == (0, 0, 0, 0, 0)
    assert _measure(f"{eight} x {eight}")[4] == 16
    assert _measure("one #*\none #*\n \n \nz\none #*")[:4] == (7, 16, 6, 2)
    assert _measure(eight)[4] == 0


def test_edges_and_hosts(spark):
    rows = edge_rows() + [(100 + k, "bad", "junk") for k in range(50)] + [(200, " ".join(f"fine{k}" for k in range(40)), "junk"), *[(201 + j, " ".join(f"fine{j}x{k}" for k in range(40)), "b") for j in range(20)]]
    docs = documents(spark, rows)
    got = quality_rules.judge(docs)
    assert got.count() == len(rows)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert kept[201] and not kept[200] and not kept[5] and not kept[9]
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, k in kept.items() if k}
    assert quality_rules.keep_good(documents(spark, [])).count() == 0


def test_host_rates_against_plain_python(spark):
    fails = {f"h{k}": (40, 2 + k % 4) for k in range(30)} | {"junk": (60, 20), "few": (3, 1), "big": (400, 30), None: (20, 1)}
    rows = [(h, k < f) for h, (n, f) in fails.items() for k in range(n)]
    hosts = quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean"))
    rates = [f / n for n, f in fails.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    k = m * (1 - m) / v - 1
    want = {h: (f + m * k) / (n + k) for h, (n, f) in fails.items()}
    got = {r.host: r for r in hosts.collect()}
    assert all(abs(got[h].rate - want[h]) < 1e-12 for h in fails) and len(got) == len(fails)
    assert {h for h in fails if got[h].rejected} == {h for h in fails if want[h] > min(quality_rules.MAX_RATE, max(quality_rules.LEAST_RATE, quality_rules.MULTIPLE * m))} == {"junk"}
    assert m < got["few"].rate < 0.15 < got["junk"].rate  # as many failures in a hundred, but three documents tell little of a host
    judged = quality_rules.with_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean"), hosts)
    assert Counter(r.host for r in judged.where("kept").collect()) == {h: n - f for h, (n, f) in fails.items() if h != "junk" and n > f}


def test_equal_hosts_lose_nothing(spark):
    rows = [(f"h{k}", j == 0) for k in range(6) for j in range(10)]
    assert spark.createDataFrame(rows, "host string, base_failed boolean").transform(quality_rules.host_verdicts).where("rejected").count() == 0


def highest_quotients(targets, seats):
    n = Counter()
    for _ in range(seats):
        n[min(targets, key=lambda s: (-targets[s] / (2 * n[s] + 1), s))] += 1
    return n


def test_quotas_are_highest_quotients(spark):
    t = {"a": 5000.0, "b": 1777.0, "c": 333.5, "d": 120.25, "e": 5000.0}
    rows = mixing.quotas(spark.createDataFrame(list(t.items()), "source string, target double"), shards=7, max_block=10).collect()
    block = rows[0].block
    seats = round(sum(t.values()) / block)
    for s in range(1, 8):
        got = Counter()
        for r in rows:
            got[r.source] += r.quota if r.shard <= s else 0
        assert +got == highest_quotients(t, seats * s // 7)


def test_mix_edges(spark):
    rows = edge_rows() + [(300 + k, "word " * (k % 17), f"s{k % 5}") for k in range(200)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert all(abs(taken[s] - t) <= max(2, 0.02 * t) for s, t in target.items())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(documents(spark, rows)).collect()))
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(documents(spark, [(1, None, "a")])).collect()} == {0}
