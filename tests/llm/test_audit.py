from itertools import permutations

from codeatlas.llm import audit


def failing(rows):
    """Brute force: the filters that each row fails."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = t.encode().split()
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            fails.add("C")
        if any(c in "#$%&*|" for c in t):
            fails.add("D")
        if i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == t for r in rows):
            fails.add("E")
        out.append(fails)
    return out


def brute(rows, labels):
    fails = failing(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r, x in left if f in x]
                left = [(r, x) for r, x in left if f not in x]
                shapley[f] += len(removed)
                lost = [sum(any(a == r[0] and r[0] is not None and b[k] == 1 for a, *b in labels) for r in removed) for k in (0, 1)]
                out[part, "".join(order), step] = [len(left), len(removed), sum(f in x for _, x in own) - len(removed), sum(x == {f} for _, x in own), *lost]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def odd(rows):
    long = " ".join(f"w{i}" for i in range(400))
    extra = [(1000 + i, long, ["de", None, "fr"][i % 3], "a", 0, None, "clash", 0.5) for i in range(9)]
    extra += [(2000, long + " #", "de", "a", 0, None, "", 0.0), (2001, long.upper(), "de", "a", 0, None, "", 0.0), (None, long, "de", "a", 0, None, "", 0.0), (None, long, "de", "a", 0, None, "", 0.0)]
    return rows + extra + [(2002, "W x " * 300, "empty of others", "a", 0, None, "", 0.0), extra[0]]


LABELS = [(12, 1, 0), (13, 0, 1), (14, 1, 1), (14, 0, None), (1001, 1, None), (None, 1, 1), (2001, None, 1), (2002, 1, 1), (999999, 1, 1)]
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_against_every_order(spark, rows, monkeypatch):
    monkeypatch.setattr(audit, "CROWD", 4)  # some texts are told by the broadcast table, others by the shuffle
    data = odd(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, score double"
    docs = spark.createDataFrame(data, schema).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in audit.interactions(docs, labels).collect()}
    assert got == brute(data, LABELS)


def test_each_state_is_visited_once(spark, monkeypatch):
    seen = []
    kept = audit.stored
    monkeypatch.setattr(audit, "stored", lambda df, name="table": (seen.append(name), kept(df, name))[1])
    rows = spark.createDataFrame([("x", True, False, True, True, False), ("x", False, True, True, False, True)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    got = {(r.gone, r.filter): (r.n, r.removed, r.good_lost, r.toxic_lost) for r in audit.trie(rows, "ABC").collect()}
    assert seen.count("state") == 7 and len(got) == 7  # three edges of the first state, two of each state that holds rows
    assert got[0, "C"] == (2, 2, 1, 1) and got[1, "C"] == (1, 1, 0, 1) and got[2, "A"] == (1, 1, 1, 0) and (3, "C") not in got


def test_empty_and_labels_missing(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(empty, labels).collect() == []
    out = audit.interactions(docs, labels).collect()
    assert len(out) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in out)
