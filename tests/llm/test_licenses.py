from itertools import combinations

from codeatlas.llm import licenses


def test_rising_is_longest():
    import random

    rng = random.Random(2)
    for _ in range(60):
        v = rng.sample(range(30), rng.randrange(9))
        best = max((len(c) for k in range(len(v) + 1) for c in combinations(v, k) if list(c) == sorted(c)), default=0)
        got = [v[i] for i in licenses.rising(v)]
        assert len(got) == best and got == sorted(got)


def test_alignment_is_a_rising_match():
    import random

    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:]))
        assert len(licenses.align(a, a)) == len(a)


def test_notices_are_found(spark, docs, rows, empty):
    filler = "the quick brown fox and version of work under free code " * 40
    texts = [filler + t + " " + filler for _, t in licenses.TEMPLATES]
    texts += [filler, texts[0] + licenses.TEMPLATES[0][1] + "\n" + licenses.TEMPLATES[2][1], "Released under the\nMIT  License", "released MIT", None, ""]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[i].license == name and got[i].coverage >= 0.99, (name, got[i])
    n = len(licenses.TEMPLATES)
    assert got[n].n_notices == 0 and got[n].license is None
    assert got[n + 1].licenses == ["Apache-2.0", "MIT"] and got[n + 1].n_notices == 3
    assert got[n + 2].license == "MIT" and [got[n + k].n_notices for k in (3, 4, 5)] == [0, 0, 0]
    assert licenses.scan_licenses(docs).count() == len(rows) and licenses.scan_licenses(empty).count() == 0


def test_notices_in_long_prose():
    """A notice is found wherever it stands, and a sibling's is not taken for it."""
    scan = licenses.Scanner(licenses.TEMPLATES, 0.8).scan
    name = lambda text: [licenses.TEMPLATES[f[0]][0] for f in scan(text.encode())]
    prose = "the use of the work and the terms of the form to any person or the source of it " * 12
    for notice, want in (
        ("Licensed under the MIT License", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
        ("is licensed under the GNU General Public License version 3", ["GPL-3.0"]),
        ("Released under the BSD License", []),
        ("Released under the Apache License", []),
        ("Licensed under the Apache License, Version 1.1", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", []),
        ("This work is licensed under the GNU Affero General Public License, version 3.", []),
        ("This work is licensed under the GNU General Public License, version 2.", []),
        ("Licensed under CC BY-ND 4.0", []),
        ("Licensed under CC BY 3.0", []),
        ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
    ):
        for text in (notice, prose + notice, notice + " " + prose, prose + notice + " " + prose):
            assert name(text) == want, (notice, len(text), name(text))


def test_an_early_word_hides_no_notice():
    text = "released " + "of the work and any terms " * 3 + "licensed under the MIT License"
    assert [licenses.TEMPLATES[f[0]][0] for f in licenses.Scanner(licenses.TEMPLATES).scan(text.encode())] == ["MIT"]


def lcs(a, b):
    """The quadratic table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequences_are_longest():
    import random

    rng = random.Random(4)
    for n in range(200):
        a, b = ([rng.choice("abcdef"[: 2 + n % 5]) for _ in range(rng.randrange(40))] for _ in range(2))
        for pairs in (licenses.common(a, b), licenses.common_with(a, b, frozenset())):
            assert len(pairs) == lcs(a, b) == licenses.common_length(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:]))


def subsequences(a, b):
    """All common subsequences."""
    subs = lambda x: {tuple(x[i] for i in range(len(x)) if m >> i & 1) for m in range(1 << len(x))}
    return subs(a) & subs(b)


def test_heavy_words_come_first():
    import random

    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.choice("abcN") for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = licenses.common_with(a, b, frozenset("N"))
        best = max((sum(w == "N" for w in c), len(c)) for c in subsequences(a, b))
        assert (sum(a[i] == "N" for i, _ in pairs), len(pairs)) == best


def test_refused_notices_take_no_longer_than_found_ones():
    import time

    scanner = licenses.Scanner(licenses.TEMPLATES)
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and "Neither" in t)
    lesser = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    other = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0-or-later").replace("version 3", "version 2") + " "
    for text, found in ((bsd.replace("PROVIDED BY", "PROVIDED FROM") + " by ", True), (lesser, False), (other, False), ("permission is hereby granted of the software to any person " * 3, False)):
        text = (text * (50_000 // len(text) + 1))[:50_000]
        began = time.process_time()
        got = scanner.scan(text.encode())
        assert bool(got) == found and time.process_time() - began < 2, (text[:40], time.process_time() - began)


def test_bsd_2_is_not_bsd_3():
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        text = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
        assert [licenses.TEMPLATES[f[0]][0] for f in scan(f"Copyright 2020 Someone. {text} More text.".encode())] == [name]


def test_scan_against_brute_force():
    """A notice is found if and only if some stretch of words has enough of a template in order."""
    import math
    import random

    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    hits = 0
    for _ in range(300):
        templates = [(f"t{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(5, 9)))) for k in range(2)]
        text = [rng.choice(words) if rng.random() < 0.7 else "x" for _ in range(rng.randrange(25))]
        if rng.random() < 0.4:
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w for w in rng.choice(templates)[1].split() if rng.random() < 0.9]
        want = set()
        for k, (_, t) in enumerate(templates):
            t = t.split()
            span, need = 2 * len(t) + licenses.GAP, math.ceil(0.8 * len(t))
            if any(lcs(text[i : i + span], t) >= need for i in range(len(text))):
                want.add(k)
        found = licenses.Scanner(tuple(templates), 0.8).scan(" ".join(text).encode())
        assert {f[0] for f in found} <= want and bool(found) == bool(want), (templates, text)
        for k, cover, first, last, n in found:
            t = templates[k][1].split()
            assert n <= lcs(text[first : last + 1], t) and abs(cover - n / len(t)) < 1e-9 and n >= 0.8 * len(t) - 1e-9
        assert all(x[3] < y[2] for x, y in zip(found, found[1:]))
        hits += bool(want)
    assert 60 < hits < 290


def test_many_notices_take_time_in_proportion():
    import time

    scan, took = licenses.Scanner(licenses.TEMPLATES).scan, []
    notice = licenses.TEMPLATES[0][1] + " " + licenses.TEMPLATES[2][1] + "\n"
    for k in (250, 2000):
        began = time.process_time()
        assert len(scan((notice * k).encode())) == 2 * k
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def test_ties_go_to_the_first_template():
    found = licenses.Scanner((("one", "alpha beta gamma delta"), ("two", "alpha beta gamma delta"))).scan(b"x alpha beta gamma delta y")
    assert [(f[0], f[2], f[3]) for f in found] == [(0, 1, 4)]
