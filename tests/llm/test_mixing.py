import re
from collections import defaultdict

import numpy as np
import pytest

from codeatlas.llm import mixing


def brute_targets(sizes, total, most=3.0):
    """Sources in code-point order, null last, weigh 1, 2, 3 in turn: raise the level in small steps, by exact fractions."""
    from fractions import Fraction

    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    cap = {s: Fraction(most) * sizes[s] for s in order}
    out, left = dict.fromkeys(order, Fraction(0)), Fraction(total)
    while left > 0 and any(out[s] < cap[s] for s in order):
        open_ = [s for s in order if out[s] < cap[s]]
        step = min(left / sum(weight[s] for s in open_), min((cap[s] - out[s]) / weight[s] for s in open_))
        for s in open_:
            out[s] += step * weight[s]
            left -= step * weight[s]
    return {s: float(v) for s, v in out.items()}


def table_of(spark, sizes):
    return {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}


def test_targets_stop_at_three_times(spark):
    t = table_of(spark, {"a": 10, "b": 1000, "c": 1})
    assert t["c"].target == 3 and t["a"].target == 30 and abs(t["b"].target - 978) < 1e-9
    for sizes in ({"a": 10, "b": 1000, "c": 1}, {"é": 5, "b": 0, None: 40, "Z": 7, "zz": 1, "y": 3000}, {"a": 0}, {"a": 7}, {f"s{i}": (i * 37) % 101 for i in range(200)}):
        got, want = table_of(spark, sizes), brute_targets(sizes, sum(sizes.values()))
        assert got.keys() == want.keys()
        for i, s in enumerate(want):
            assert got[s].source_no == i and abs(got[s].target - want[s]) < 1e-6 and got[s].rate <= 3


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(3)
    size = rng.integers(0, 500, 400).astype(float)
    p = np.full(400, 0.37)
    q = mixing.flight(p, np.column_stack([size * p, p]), np.random.default_rng(1))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-4
    many = np.mean([mixing.flight(p[:8], np.column_stack([size[:8] * p[:8], p[:8]]), np.random.default_rng(s)) for s in range(600)], axis=0)
    assert np.abs(many - 0.37).max() < 0.1


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    for g in got:
        assert g.size == words[g.doc_id] and g.taken == g.copies * g.size <= 3 * g.size
        sizes[g.source] += g.size
        taken[g.source] += g.taken
        goal[g.source] = g.target
    expected = brute_targets(sizes, sum(sizes.values()))
    for s in expected:
        most = max(g.size for g in got if g.source == s)
        assert abs(goal[s] - expected[s]) < 1e-6 and abs(taken[s] - goal[s]) <= 1.5 * most
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_take_and_empty(docs, empty):
    mixed = {}
    for g in mixing.mix(docs).collect():
        mixed[g.doc_id] = mixed.get(g.doc_id, 0) + g.copies
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in mixed.items() if v}
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("most", [0, 200_000])
def test_blocks_of_one_source(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_SOURCES", most)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 90 as int)) as text", "if(id % 3 = 0, 'x', 'hot') as source")
    rows = mixing.mix(docs).collect()
    for s in ("x", "hot"):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 200
    units = docs.selectExpr("1 as source_no", "cast(doc_id as string) as key", "doc_id % 90 as size", "0.4 as p").selectExpr("cast(source_no as int) source_no", "key", "cast(size as long) size", "cast(p as double) p")
    chosen = mixing.balanced(units, per_block=100).filter("p = 1").selectExpr("count(1) n", "sum(size) s").first()
    assert abs(chosen.n - 1200) <= 3 and abs(chosen.s - 0.4 * 3000 * 44.5) < 400


def test_every_source_lands_within_a_median_document(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('w ', cast(20 + (id * 7919) % 700 as int)) as text", "concat('s', id % 20) as source")
    rows = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) < sorted(r.size for r in own)[len(own) // 2]
    again = mixing.mix(docs.repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_clashing_names_and_null_ids(spark):
    rows = [(i if i % 5 else None, "word " * (i % 30), f"s{i % 3}", "x", i, True) for i in range(300)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, copies int, __key boolean")
    out = mixing.take(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.take(docs.limit(0)).count() == 0
