import hashlib

import pytest

from codeatlas.llm import suffix


def brute(rows, k=100):
    seen, out = {}, {}
    for i in sorted({r[0] for r in rows}):
        raw = next((r[1] for r in rows if r[0] == i), None)
        raw = (raw or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - k + 1):
            w = raw[s : s + k]
            if w in seen:
                gone[s : s + k] = b"\1" * k
            else:
                seen[w] = (i, s)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(left).hexdigest(), left)
    return out


def test_removal_matches_brute_force(docs, rows):
    expected = brute(rows)
    got = suffix.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256, bytes(g.kept_bytes)) == expected[g.doc_id], g.doc_id
    assert sum(g.n_removed > 0 for g in got) > 5


@pytest.mark.parametrize("crowded", [256, 3, 0])
def test_many_overlapping_passages(spark, monkeypatch, crowded):
    import random

    monkeypatch.setattr(suffix, "CROWDED", crowded)

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(7))
    pool = ["".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool)[rng.randrange(0, 30) :] + word() * rng.randrange(3) for _ in range(rng.randrange(1, 8)))) for i in range(80)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256, bytes(g.kept_bytes)) for g in got} == brute(rows)


def test_empty(empty):
    assert suffix.remove_repeats(empty).count() == 0


def test_shared_and_null_ids(spark):
    text = "".join(chr(97 + i * i % 23) + str(i % 7) for i in range(90))
    rows = [(3, text), (3, "other " + text), (3, text), (None, text + "!"), (None, None), (1, "short")]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and sum(g.n_removed > 0 for g in got) == 2  # of one id's texts, the shorter comes first
    assert [g.n_removed for g in got if g.doc_id is None and g.n_bytes] == [180]


@pytest.mark.parametrize("sizes", [(8, 100, 400), (512, 256, 8192), (3, 20, 150)])
def test_repetitive_texts_and_borders_of_phrases(spark, monkeypatch, sizes):
    import random

    for name, value in zip(("SPACING", "SHORTEST", "LONGEST"), sizes):
        monkeypatch.setattr(suffix, name, value)
    monkeypatch.setattr(suffix, "TOGETHER", 50)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    rng = random.Random(5)
    line = "".join(chr(rng.randrange(97, 123)) for _ in range(130))
    other = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    rows = [(i, other(rng.randrange(0, 300)) + line * rng.randrange(1, 3) + other(rng.randrange(0, 300))) for i in range(60)]
    rows += [(100, "a" * 5000), (101, "b" + "a" * 4000), (102, "ab" * 1500), (103, "\0" * 300), (104, "\0" * 150 + "x" + "\0" * 200), (105, line[:99]), (106, line[:100]), (107, "é" * 200)]
    rows += [(200 + i, rows[i][1][k:]) for i, k in enumerate((0, 1, 40, 200))]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {g.doc_id: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256, bytes(g.kept_bytes)) for g in got} == brute(rows)


@pytest.mark.parametrize("sizes", [(8, 100, 400), (3, 20, 150)])
def test_parse_is_prefix_free_and_covers_every_window(monkeypatch, sizes):
    import numpy as np

    for name, value in zip(("SPACING", "SHORTEST", "LONGEST"), sizes):
        monkeypatch.setattr(suffix, name, value)
    raw = np.random.default_rng(3).integers(97, 100, 20_000, np.uint8)
    cut = suffix.phrases(suffix.triggers(raw).tolist(), len(raw))
    assert [a for a, _ in cut] == [0, *np.cumsum([n for _, n in cut])[:-1]] and sum(n for _, n in cut) == len(raw) - 99
    texts = sorted({raw[a : a + n + 99].tobytes() for a, n in cut[:-1]})
    assert not any(b.startswith(a) for a, b in zip(texts, texts[1:]))
