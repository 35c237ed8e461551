import math
import random
import zlib

import numpy as np
import pytest

from codeatlas.llm import gam

SYLLABLES = "ta re mi no lu ka se di po ven gar lis tor".split()


def text(rng, good):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
    if good:
        return " ".join(words).capitalize() + "."
    kind = rng.randrange(4)
    if kind == 0:
        return " ".join(w + rng.choice(["***", "###", "$$$"]) for w in words)
    if kind == 1:
        return " ".join(words).upper() + "!!"
    if kind == 2:
        return " | ".join(words)
    return " ".join([words[0]] * len(words))


def sample(n, seed=5):
    rng = random.Random(seed)
    return [(i, text(rng, i % 5 > 0), int((i % 5 > 0) != (i % 50 == 7))) for i in range(n)]  # one label in fifty is wrong


@pytest.fixture(scope="module")
def trained(spark):
    rows = sample(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels, gam.train(docs, labels)


def test_held_out_accuracy(trained):
    rows, docs, _, model = trained
    got = {r.doc_id: r for r in gam.score(docs, model).collect()}
    right = n = 0
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert got[i].predicted == int(got[i].score >= 0.7)
        if got[i].held_out:
            n += 1
            right += got[i].predicted == int(i % 5 > 0)
    assert n > 200 and right / n > 0.97


def test_scores_are_sums_of_table_entries(trained):
    rows, docs, _, model = trained
    got = {r.doc_id: r.score for r in gam.score(docs, model).collect()}
    assert model.pairs and any(np.abs(t).max() > 0 for t in model.tables)
    for i, t, _ in rows[:60]:
        x = gam.features(t.encode())
        bins = [sum(e <= v for e in edges) for v, edges in zip(x, model.edges)]
        z = model.bias + sum(table[b] for table, b in zip(model.tables, bins))
        for (j, k), table in model.pairs.items():
            z += table[bins[j] * gam.COARSE // len(model.tables[j])][bins[k] * gam.COARSE // len(model.tables[k])]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_only_learnt_rows_count(spark, trained):
    rows, docs, _, model = trained
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, quality int")
    again = gam.train(docs, flipped)
    assert again.bias == model.bias and all((a == b).all() for a, b in zip(again.tables, model.tables)) and again.pairs.keys() == model.pairs.keys()


def test_tree_against_all_cuts():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(1, 9)
        g, h = rng.normal(size=n), rng.random(n)
        worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + gam.RIDGE)  # noqa: B023, E731
        best = max([worth(0, n), *(worth(0, c) + worth(c, n) for c in range(1, n))])
        values = gam.tree(g, h, 2)
        assert (values * g).sum() == pytest.approx(best)  # a leaf gives its sum times sum / (weights + ridge)
        shape = rng.integers(2, 6, 2)
        g, h = rng.normal(size=shape), rng.random(shape)
        parts = lambda i, j: [np.s_[:i, :j], np.s_[:i, j:], np.s_[i:, :j], np.s_[i:, j:]]
        best = max(sum(g[s].sum() ** 2 / (h[s].sum() + gam.RIDGE) for s in parts(i, j)) for i in range(1, shape[0]) for j in range(1, shape[1]))
        gain, values = gam.quadrants(g, h)
        assert (values * g).sum() == pytest.approx(best) and gain == pytest.approx(best - g.sum() ** 2 / (h.sum() + gam.RIDGE))


def test_features():
    assert gam.features(b"") == gam.features(b" \n\t") == [0.0] * len(gam.FEATURES)
    f = dict(zip(gam.FEATURES, gam.features("a a B! 日\na a".encode())))
    assert f["words that repeat the one before"] == pytest.approx(2 / 6) and f["distinct words"] == 0.5 and f["repeated lines"] == 0
    assert f["capitals"] == pytest.approx(1 / 8) and f["exclamations"] == pytest.approx(1 / 6) and f["most frequent word"] == pytest.approx(4 / 6)
    assert len(gam.features(b"w " * 2_000_000)) == len(gam.FEATURES)


def test_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, None, 0), (None, 0, 1), (12, 1, 0), (12, 0, 0), (13, 1, 0), (14, 0, 0), (14, 0, 1)], "doc_id long, quality int, toxic int")
    out = gam.score(docs, gam.train(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by_id = {}
    assert all(by_id.setdefault(r.doc_id, r.score) == r.score for r in out)
    assert by_id[0] == by_id[1] == by_id[2]  # null, empty and blank texts
    assert gam.score(empty, gam.train(empty, labels)).collect() == []
    one_class = gam.train(docs, labels.filter("quality = 1"))
    assert not one_class.tables and {r.score > 0.5 for r in gam.score(docs, one_class).collect()} == {True}
    assert {r.score for r in gam.score(docs, gam.train(docs, labels.filter("doc_id < 0"))).collect()} == {0.5}
