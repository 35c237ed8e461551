import os
import random

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import traces
from codeatlas.streaming.traces import DAY, TraceStore, rates

SPAN = "span_id string, trace_id string, parent_span_id string, name string, source string, started_ms bigint, duration_ms double"
LOG = "trace_id string, span_id string, level string, message string, timestamp_ms bigint"
NOW = 1_700_000_000_000


def spans(seed, n=60):
    """Spans of a few traces, some without a root, some with two, ties, nulls, and a null trace."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        trace = rng.choice(["t", "u", "v", "é", None])
        parent = None if rng.random() < 0.1 and trace not in ("v", None) else f"s{rng.randrange(n)}"
        rows.append((f"s{i}", trace, parent, f"n{i % 7}", rng.choice(["cli", None]), NOW + rng.randrange(30), rng.choice([None, 0.0, 2.5, 40.0])))
    return rows


def feed(spark, source, rows, schema=SPAN):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))


def run(spark, store, source, checkpoint, name="spans", schema=SPAN, **kw):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = store.ingest(stream, name, str(checkpoint), **kw)
    assert query.awaitTermination(120)


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_spans_in_any_order_give_the_batch_roll_up(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = spans(seed)
    late = rows[:]
    rng.shuffle(late)
    store = TraceStore(spark, str(tmp_path / "store"))
    for part in (late[:20], late[10:45], late[45:] + late[:5]):
        feed(spark, tmp_path / "in", part)
    run(spark, store, tmp_path / "in", tmp_path / "c")
    whole = spark.createDataFrame(rows, SPAN)
    assert shown(store.traces()) == shown(traces.roll_up(whole))
    assert sorted(r.span_id for r in store.spans().collect()) == sorted(r[0] for r in rows)
    feed(spark, tmp_path / "in", rows)  # all of them again, by the same stream and by a new one
    for checkpoint in ("c", "d"):
        run(spark, store, tmp_path / "in", tmp_path / checkpoint)
        assert shown(store.traces()) == shown(traces.roll_up(whole)) and store.spans().count() == len(rows)


def test_what_is_read_is_a_row_per_change(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "store"))
    feed(spark, tmp_path / "in", [(f"s{i}", f"t{i % 3}", None, "n", "cli", NOW + i, 1.0) for i in range(300)])
    run(spark, store, tmp_path / "in", tmp_path / "c")
    assert store._read("traces", "trace_id string").count() == 3


def test_traces_settle_and_their_state_goes(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "store"))
    at = lambda trace, i, ms: (f"{trace}{i}", trace, None, f"{trace}{i}", "cli", NOW + ms, 1.0)
    for rows in ([at("a", 0, 0), at("b", 0, 50_000)], [at("b", 1, 60_000)], [at("a", 9, 10), at("c", 0, 70_000)]):
        feed(spark, tmp_path / "in", rows)
        run(spark, store, tmp_path / "in", tmp_path / "c", lateness="10 seconds")
    assert {r.trace_id for r in store.settled().collect()} == {"a", "b"}
    assert {r.trace_id: r.started_ms for r in store.traces().collect()} == {"a": NOW, "b": NOW + 50_000, "c": NOW + 70_000}
    assert store.spans().filter("span_id = 'a9'").count() == 0  # over 10 seconds late
    feed(spark, tmp_path / "in", [at("a", 5, 80_000)])  # a trace that goes on after its state has gone
    run(spark, store, tmp_path / "in", tmp_path / "c", lateness="10 seconds")
    again = store.traces().filter("trace_id = 'a'").first()
    assert (again.root_span_name, again.started_ms, again.ended_ms) == ("a0", NOW, NOW + 80_001)


def test_retention_drops_days_and_writes_nothing(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "store"))
    span = lambda i, trace, ms: (f"{trace}{i}", trace, None if i == 0 else f"{trace}0", "n", "cli", ms, 5.0)
    rows = [span(0, "old", DAY), span(0, "edge", 3 * DAY + 10), span(1, "edge", 4 * DAY), span(0, "same", 3 * DAY + 900), span(0, "new", 9 * DAY), span(1, "new", 9 * DAY + 5)]
    feed(spark, tmp_path / "in", rows)
    run(spark, store, tmp_path / "in", tmp_path / "c")
    logs = [("old", None, "info", "x", DAY), ("t", None, "info", "x", 3 * DAY + 1), ("t", None, "info", "x", 3 * DAY + 500), (None, None, "info", "x", 9 * DAY)]
    feed(spark, tmp_path / "logs", logs, LOG)
    run(spark, store, tmp_path / "logs", tmp_path / "cl", "logs", LOG)
    now, frames = 10 * DAY + 500, [spark.createDataFrame(r, s) for r, s in ((rows, SPAN), (logs, LOG))]
    want = traces.kept(traces.roll_up(frames[0]), frames[0], frames[1], now)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "store") for f in names}
    before = files()
    for _ in range(2):
        got = store.retain(now)
        assert shown(got[0]) == shown(want[0]) and {r.span_id for r in got[1].collect()} == {r.span_id for r in want[1].collect()} and shown(got[2]) == shown(want[2])
    assert files() < before
    days = lambda name: sorted(int(d[4:]) for d in os.listdir(tmp_path / "store" / name) if d.startswith("day="))
    assert days("spans") == [3, 4, 9] and days("traces") == [3, 9] and days("logs") == [3, 9]
    assert [df.count() for df in store.retain(20 * DAY)] == [0, 0, 0] and days("spans") == []
    assert [df.count() for df in TraceStore(spark, str(tmp_path / "none")).retain(0)] == [0, 0, 0]


def test_a_batch_that_failed_counts_once(spark, tmp_path, monkeypatch):
    store = TraceStore(spark, str(tmp_path / "store"))
    feed(spark, tmp_path / "in", spans(3))
    write_whole = TraceStore._write

    def stops(self, name, *args):
        if name == "traces":
            raise RuntimeError("lost")
        write_whole(self, name, *args)

    monkeypatch.setattr(TraceStore, "_write", stops)
    with pytest.raises(Exception, match="lost"):
        run(spark, store, tmp_path / "in", tmp_path / "c")
    assert store.traces().count() == 0
    monkeypatch.setattr(TraceStore, "_write", write_whole)
    run(spark, store, tmp_path / "in", tmp_path / "c")
    assert store.spans().count() == 60 and shown(store.traces()) == shown(traces.roll_up(spark.createDataFrame(spans(3), SPAN)))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_payloads_are_kept(spark, tmp_path):
    schema = SPAN + ", error_message string, input_size bigint, input string, other int"
    source = tmp_path / "in"
    spark.createDataFrame([("a", "t", None, "n", "cli", NOW, 1.5, "e", 2**60 + 1, "text", 7), ("b", "t", "a", "n", "cli", NOW + 1, None, None, None, None, None)], schema).coalesce(1).write.parquet(str(source))
    store = TraceStore(spark, str(tmp_path / "store"))
    run(spark, store, source, tmp_path / "c", schema=schema)
    got = {r.span_id: r for r in store.spans().withColumn("x", F.lit(1)).collect()}
    assert got["a"].input_size == 2**60 + 1 and got["a"].input == "text" and got["b"].duration_ms is None and got["b"].output is None


def test_rates_by_window(spark):
    rows = [("a", "t", None, "x", "cli", 0, 1.0, None), ("b", "t", None, "x", "cli", 299_999, 3.0, "e"), ("c", "t", None, "x", "cli", 300_000, 5.0, None), ("d", "t", None, "y", "cli", 1, None, None)]
    got = rates(spark.createDataFrame(rows, SPAN + ", error_message string")).collect()
    assert {(r.window.start.timestamp(), r.name): (r.spans, r.errors, r.mean_ms) for r in got} == {(0.0, "x"): (2, 1, 2.0), (300.0, "x"): (1, 0, 5.0), (0.0, "y"): (1, 0, None)}


def test_traces_of_many_weeks_in_any_order_are_whole(spark, tmp_path):
    """conv_id counts minutes, so a table of many conversations spans weeks, and its files are not in order of time."""
    week = 7 * DAY
    rows = [(f"{t}-{i}", f"t{t}", f"{t}-0" if i else None, f"n{i}", "cli", NOW + t * week + i, 1.0) for t in range(5) for i in range(3)]
    for part in (rows[12:], rows[:5], rows[9:12], rows[5:9]):
        feed(spark, tmp_path / "in", part)
    store = TraceStore(spark, str(tmp_path / "store"))
    for checkpoint in ("c", "d"):
        run(spark, store, tmp_path / "in", tmp_path / checkpoint, lateness=None)
        assert shown(store.traces()) == shown(traces.roll_up(spark.createDataFrame(rows, SPAN))) and store.spans().count() == len(rows)
