import random
import zlib

import numpy as np

from codeatlas.llm import toxicity

BAD = "scoundrel numbskull blockhead ruffian vermin".split()


def sample(n, seed=3):
    rng = random.Random(seed)
    syllables = "ta re mi no lu ka se di po ven gar lis tor".split()
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 160))]
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words).capitalize(), int(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = sample(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    right = n = 0
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        assert got[i].predicted == int(got[i].score >= 0.5)
        if got[i].held_out:
            right += got[i].predicted == y
            n += 1
    assert right / n > 0.93


def test_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (12, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    assert toxicity.score(empty, model).count() == 0
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(docs, none).count() == len(rows)


def test_calibration_separates():
    x = np.concatenate([np.random.default_rng(0).normal(m, 1, (200, 2)) for m in (0, 3)])
    y = np.repeat([0.0, 1.0], 200)
    w = toxicity.calibrate(x, y)
    assert (((w[0] + x @ w[1:]) > 0) == y).mean() > 0.95


def test_long_windows_are_read_to_their_end():
    rows = sample(600)
    model = toxicity.fit([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    junk = bytes(np.random.default_rng(1).integers(0x80, 0xC0, 150_000, np.uint8))
    bad = "　".join(BAD * 3).encode()
    first, last = model.features(bad + junk), model.features(junk + bad)
    assert first[1] >= toxicity.HIT and last[1] >= 0.6 * first[1]
    text = bytes(range(33, 127)) * 20
    parts = list(toxicity.windows(text, 30))
    assert all(any(text.lower()[i : i + 30] in p for p in parts) for i in range(len(text) - 29)) and max(map(len, parts)) <= 286


def test_dictionaries_are_equal_in_size_and_thresholds_see_other_rows(monkeypatch):
    rows = sample(600)
    texts, marks = [t.encode() for _, t, _ in rows], [y for *_, y in rows]
    seen = []
    real = toxicity.Model.features
    monkeypatch.setattr(toxicity.Model, "features", lambda self, t, pair=0: seen.append((t, pair)) or real(self, t, pair))
    model = toxicity.fit(texts, marks)
    assert len(model.pairs) == 2 and all(len(a) == len(b) and a != b for a, b in model.pairs)
    assert any(w.encode() in model.pairs[0][1] for w in BAD) and not any(w.encode() in model.pairs[0][0] for w in BAD)
    by_class = {0: [], 1: []}
    for t, y in zip(texts, marks):
        by_class[y].append(t)
    trained = [{t for own in by_class.values() for t in own[k::2]} for k in (0, 1)]
    assert len(seen) == len(texts) and all(t not in trained[pair] or t in trained[1 - pair] for t, pair in seen)


def test_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: got.append((texts, marks)))
    docs = spark.createDataFrame([(i % 50, f"text {i} " * (500 if i % 10 == 0 else 5)) for i in range(2000)] + [(7, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] * 3 + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    usable = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    toxicity.train(docs, labels)
    toxicity.train(docs, labels, sample=9)
    toxicity.train(docs, labels, sample_bytes=3000)
    toxicity.train(docs, labels.limit(0))
    assert len(got[0][0]) == len(usable) and len(got[1][0]) == 9 and 0 < sum(map(len, got[2][0])) <= 3000 and got[3] == ([], [])


def test_training_runs_in_a_task(spark, monkeypatch):
    """The driver sees no text: what fit() needs is found in the task, and the model is that of the same rows in the driver."""
    texts = [f"{'vile slur words ' if i % 3 == 0 else 'plain calm talk '}number {i} of the day" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    free = [r.doc_id for r in docs.filter(~toxicity.held_out(docs["doc_id"])).collect()]
    rows = sorted((texts[i].encode(), int(i % 3 == 0)) for i in free)
    order = np.random.default_rng(9).permutation(len(rows))
    want = toxicity.fit([rows[i][0] for i in order], [rows[i][1] for i in order])

    def driver(*args):
        raise AssertionError("trained in the driver")

    with monkeypatch.context() as m:
        m.setattr(toxicity, "windows", driver)
        m.setattr(toxicity, "calibrate", driver)
        got = toxicity.train_in_task(docs, labels)
    assert got.pairs == want.pairs and got.weights.tolist() == want.weights.tolist()
