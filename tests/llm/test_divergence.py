import random
import re
from collections import Counter

import numpy as np

from codeatlas.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, count double, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=3, ranks=200):
    """All groups, all kept terms, all pairs, in plain integers."""
    out = set()
    for lang in {r[2] or "" for r in rows}:
        own = [(r[3] or "", terms(r[1])) for r in rows if (r[2] or "") == lang]
        df = Counter(t for _, ts in own for t in set(ts))
        kept = sorted((t for t in df if df[t] >= least), key=lambda t: t.encode())
        count = {s: Counter(t for s2, ts in own if s2 == s for t in ts if df[t] >= least) for s, _ in own}
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in count.items():
            pairs = sorted(((-sum(f(p(c, t), p(count[o], t)) for t in kept), o.encode(), o) for o in count if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            best = sorted((-f(p(c, t), p(whole, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t))
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(best[:ranks], 1)}
    return out


def corpus(seed=2, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "and", "a", "naïve", "Ångström", "日本", "x1y", "don't", "İstanbul", "ÀB"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ",", "-", "\0", "."]) for _ in range(rng.randrange(0, 90)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "b", "c", None, "é"]), 0, "clash", 0.5, 1))
    rows += [(900, None, "en", "no text", 0, None, None, None), (901, "", "no terms", "a", 0, None, None, None), (902, "12 34", "no terms", "b", 0, None, None, None), (None, "the the", "en", "b", 0, None, None, None)]
    return rows + [rows[0], rows[0], rows[1]]


def result(df):
    return {tuple(r) for r in df.collect()}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 300)
    monkeypatch.setattr(divergence, "PAIRS", 64)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = divergence.divergences(docs, parts=3)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = out.collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows)


def test_ranks_and_ties(spark):
    rows = [(i, " ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), "en", s, 0, None, None, None) for i, s in enumerate(["a", "a", "a"])]
    rows += [(10 + i, "other words", "en", "b", 0, None, None, None) for i in range(3)]
    got = result(divergence.divergences(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len([r for r in got if r[1:3] == ("a", "term")]) == 200
    few = result(divergence.divergences(spark.createDataFrame(rows, SCHEMA), ranks=2))
    assert few == brute(rows, ranks=2)


def test_recount_is_delimited(monkeypatch):
    found = divergence.recount(b"a aa a b aab aa a", [b"a", b"aa", b"b", b"ab", "é".encode()])
    assert found.tolist() == [3, 2, 1, 0, 0]
    assert divergence.recount(b"", [b"a"]).tolist() == [0] and divergence.recount(b"a", []).tolist() == []
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert divergence.recount(b"a aa a b aab aa a", [b"a", b"aa", b"b", b"ab"]).tolist() == [3, 2, 1, 0]
    text = ("é " * 200_000).encode() + b"e"
    assert divergence.recount(text, ["é".encode(), b"e"]).tolist() == [200_000, 1]


def test_large_counts_stay_whole(spark):
    """p is worked out in decimals: 10**9 times a count need not fit a long."""
    expression = "1 + (1000000000BD * (cast(c as decimal(20)) + 1)) div nullif(cast(n + v as decimal(20)), 0) AS p"
    c, n, v = 9 * 10**15 + 7, 10**16 + 3, 12345
    assert spark.range(1).selectExpr(f"{c}L AS c", f"{n}L AS n", f"{v}L AS v").selectExpr(expression).first().p == 1 + 10**9 * (c + 1) // (n + v)


def test_empty_and_single(spark, empty):
    assert result(divergence.divergences(empty)) == set()
    one = spark.createDataFrame([(1, "a a a", "en", "x", 0, None, None, None)], SCHEMA)
    assert result(divergence.divergences(one)) == set()
    rows = [(i, "w " * 400_000 + f"v{i % 2}", "en", f"s{i % 2}", 0, None, None, None) for i in range(4)]  # long texts of one word
    assert result(divergence.divergences(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_changes():
    import pyarrow as pa

    t = pa.table({"lang": ["a", "a", "b", "b"], "term": ["x", "x", "x", "y"]})
    assert np.flatnonzero(divergence._changes(t)).tolist() == [1, 2] and not len(divergence._changes(t.slice(0, 1)))
