import random

import pytest

from codeatlas.streaming.sessions import DAY, SessionStore, sessions

EVENT = "key string, at_ms bigint, error boolean"
GAP, LATE = 1000, 5000


def by_hand(events, gap=GAP):
    out = []
    for key in {e[0] for e in events}:
        own = sorted((t, bool(bad)) for k, t, bad in events if k == key)
        for t, bad in own:
            if out and out[-1][0] == key and t - out[-1][2] <= gap:
                out[-1] = (key, out[-1][1], t, out[-1][3] + 1, out[-1][4] + bad)
            else:
                out.append((key, t, t, 1, int(bad)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def events(seed, n=150):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", None]), DAY - 20_000 + rng.randrange(40_000), rng.choice([True, False, None])) for _ in range(n)]


def test_sessions_of_a_table(spark):
    for seed in range(3):
        made = events(seed)
        assert rows(sessions(spark.createDataFrame(made, EVENT).na.fill(False), GAP)) == by_hand(made)
    assert rows(sessions(spark.createDataFrame([("a", 0, False), ("a", 1000, True), ("a", 2001, False)], EVENT), GAP)) == [("a", 0, 1000, 2, 1), ("a", 2001, 2001, 1, 0)]
    assert rows(sessions(spark.createDataFrame([], EVENT), GAP)) == []


@pytest.mark.parametrize("seed", range(2))
def test_batches_without_order(spark, tmp_path, seed):
    """Each batch against all that came, less what was late when it came."""
    rng = random.Random(seed)
    made = sorted(events(seed), key=lambda e: e[1] + rng.randrange(9000))
    store = SessionStore(spark, str(tmp_path / "store"), GAP, LATE)
    newest, counted, late = None, [], []
    for n, part in enumerate((made[:50], made[50:90], made[90:], [("z", None, None)], [])):
        feed = spark.createDataFrame(part, EVENT)
        for _ in range(2):  # a batch that comes again
            store.add(feed, n)
        mark = None if newest is None else newest - LATE
        late += [e for e in part if e[1] is None or mark is not None and e[1] < mark]
        counted += [e for e in part if e[1] is not None and not (mark is not None and e[1] < mark)]
        newest = max([newest or 0, *(e[1] for e in part if e[1] is not None)])
        got = rows(store.closed()) + rows(store.open())
        assert sorted(got, key=str) == by_hand(counted)
        assert rows(store.late()) == sorted(((e[0], e[1]) for e in late), key=str)
        assert all(s[2] + GAP < newest - LATE for s in rows(store.closed())) and all(s[2] + GAP >= newest - LATE for s in rows(store.open()))
    assert late and rows(store.closed())


def test_a_stream_of_events(spark, tmp_path):
    made = sorted(events(7), key=lambda e: e[1])
    store = SessionStore(spark, str(tmp_path / "store"), GAP, LATE)
    for k in range(0, len(made), 50):
        spark.createDataFrame(made[k : k + 50], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        assert store.follow(stream, str(tmp_path / "c")).awaitTermination(100)
    assert sorted(rows(store.closed()) + rows(store.open()), key=str) == by_hand(made) and store.late().count() == 0
