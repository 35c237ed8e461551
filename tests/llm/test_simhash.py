import re

import pytest
import xxhash

from codeatlas.llm import components, simhash


def brute(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(k, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_of(points, distance=4):
    label = {p: p for p in points}
    todo = set(points)
    while todo:
        front = [todo.pop()]
        own = [front[0]]
        while front:
            x = front.pop()
            near = [y for y in todo if (x ^ y).bit_count() <= distance]
            todo.difference_update(near)
            front += near
            own += near
        for x in own:
            label[x] = min(own)
    return label


def test_near_groups_match_brute_force(docs, rows):
    got = simhash.near_groups(docs).collect()
    fps = {r[0]: brute(r[1]) for r in rows}
    label = groups_of(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    assert len(got) == len(rows)
    for g in got:
        assert g.fp % (1 << 64) == fps[g.doc_id] and g.component_id == least[label[fps[g.doc_id]]]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("cold", [8, 1_000])
def test_hot_buckets_lose_no_link(spark, monkeypatch, wide, cold):
    monkeypatch.setattr(simhash, "COLD", cold)
    monkeypatch.setattr(simhash, "CELL", 16)
    if wide:
        monkeypatch.setattr(simhash, "SEGMENTS", simhash.SEGMENTS[1:])  # as for more than 2**27 fingerprints
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    points = {b ^ sum(1 << k for k in rng.sample(range(20, 50), rng.randrange(7))) for b in base for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    got = {r.node % (1 << 64): r.label for r in components.connected_components(simhash.links(df)).collect()}
    label = groups_of(points)
    mine = {}
    for p in points:
        mine.setdefault(got.get(p, p), set()).add(p)
    true = {}
    for p in points:
        true.setdefault(label[p], set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, true.values()))


def test_probes_of_a_small_bucket_are_dealt_out_too(spark, monkeypatch):
    """A bucket of few entries beside a bucket of many: its probes meet in cells, not in one task."""
    monkeypatch.setattr(simhash, "COLD", 8)
    monkeypatch.setattr(simhash, "CELL", 16)
    import random

    rng = random.Random(6)
    many = {rng.getrandbits(43) << 21 | 0b100 for _ in range(300)}
    few = {p ^ 0b101 ^ (1 << rng.randrange(30, 64)) for p in list(many)[:5]}
    points = many | few
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    crowded = simhash.links(df)
    got = {r.node % (1 << 64): r.label for r in components.connected_components(crowded).collect()}
    label = groups_of(points)
    assert {p for p in points if label[p] != p or sum(label[q] == p for q in points) > 1} == set(got)
    for p in few:
        assert sum(got.get(q) == got[p] for q in points) > 1


def test_every_pair_within_the_distance_has_a_segment_within_its_radius():
    from itertools import combinations

    for _, segments in simhash.SEGMENTS:
        assert sum(w for _, w, _ in segments) == 64 and sum(r + 1 for *_, r in segments) > simhash.DISTANCE
        for _, width, radius in segments:
            masks = simhash._masks(width, radius)
            assert len(masks) == sum(len(list(combinations(range(width), n))) for n in range(1, radius + 1))
            assert all(m.bit_length() == top.bit_length() and m.bit_count() <= radius for m, top in masks)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (139, 200)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in [*range(100, 140), 200]}


def test_one_of_each_and_empty(docs, empty):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    groups = {r.component_id for r in simhash.near_groups(docs).collect()}
    assert {r.doc_id for r in left.collect()} == groups
    assert simhash.near_groups(empty).count() == 0
