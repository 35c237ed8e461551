import os
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeatlas.catalog import Catalog, insert_new, upsert
from codeatlas.functions import formats
from codeatlas.operators import graph, history, layout, traces
from codeatlas.sources import files as S
from codeatlas.streaming.traces import Recorder, TraceStore, distinct_spans

AS_OF = datetime(2026, 1, 31)


def commits(spark):
    big = [f"f{i}.ts" for i in range(51)]
    rows = [("a", datetime(2026, 1, 10, 10), ["src/a.ts", "src/b.ts"]), ("b", datetime(2025, 1, 10, 10), ["src/b.ts", "src/a.ts", "src/c.ts"]), ("c", datetime(2026, 1, 1), big), ("d", None, ["src/a.ts"])]
    return spark.createDataFrame(rows, "hash string, ts timestamp, files array<string>")


def test_history(spark):
    changes = history.commit_files(commits(spark))
    got = {r.path: (r.commit_count, r.recent_count, r.last_modified) for r in history.file_stats(changes, AS_OF).collect()}
    assert got == {"src/a.ts": (2, 1, datetime(2026, 1, 10, 10)), "src/b.ts": (2, 1, datetime(2026, 1, 10, 10)), "src/c.ts": (1, 0, datetime(2025, 1, 10, 10))}
    pairs = {(r.path_a, r.path_b): r.cochange_count for r in history.cochanges(changes).collect()}
    assert pairs == {("src/a.ts", "src/b.ts"): 2, ("src/a.ts", "src/c.ts"): 1, ("src/b.ts", "src/c.ts"): 1}
    fifty = spark.createDataFrame([("x", AS_OF, [f"f{i}" for i in range(50)])], commits(spark).schema)
    assert history.cochanges(history.commit_files(fifty)).count() == 1225


def test_recency_is_inclusive(spark):
    at = datetime(2025, 11, 2)
    rows = spark.createDataFrame([("x", at, "a"), ("y", datetime(2025, 11, 1, 23, 59), "a")], "hash string, ts timestamp, path string")
    assert history.file_stats(rows, AS_OF).first().recent_count == 1


def test_commit_log(spark, tmp_path):
    h = ["%040x" % i for i in (1, 2, 3)]
    (tmp_path / "log.txt").write_text(f'{h[0]}\0002026-01-10T10:00:00+00:00\n\nsrc/a.ts\n"src/b.ts"\n\n{h[1]}\0002025-01-10T10:00:00+00:00\n\nsrc/b.ts\n{h[2]}\000not a date\n\nx.ts\n')
    got = {r.hash: (r.ts, r.files) for r in S.parse_log(spark, str(tmp_path / "log.txt")).collect()}
    assert got == {h[0]: (datetime(2026, 1, 10, 10), ["src/a.ts", "src/b.ts"]), h[1]: (datetime(2025, 1, 10, 10), ["src/b.ts"])}


def test_tree_and_changes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("export const a = 1")
    (tmp_path / "logo.PNG").write_bytes(b"\0")
    (tmp_path / "edge.py").write_bytes(b"x" * (2 * 1024 * 1024))
    (tmp_path / "big.py").write_bytes(b"x" * (2 * 1024 * 1024 + 1))
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "."], check=True)
    old = S.scan_tree(spark, str(tmp_path))
    assert {(r.path, r.language) for r in old.select("path", "language").collect()} == {("src/a.ts", "typescript"), ("edge.py", "python")}
    before = spark.createDataFrame([("src/a.ts", "other"), ("gone.ts", "x")], "path string, content_hash string")
    assert {(r.path, r.status) for r in S.change_set(before, old).collect()} == {("src/a.ts", "modified"), ("gone.ts", "deleted"), ("edge.py", "added")}
    lines = spark.createDataFrame([("A\tnew.ts",), ("D\told.ts",), ("M\tmod.ts",), ("R100\tfrom.ts\tto.ts",)], "value string")
    assert {(r.path, r.status) for r in S.name_status(lines).collect()} == {("new.ts", "added"), ("old.ts", "deleted"), ("mod.ts", "modified"), ("from.ts", "deleted"), ("to.ts", "added")}


def test_git_listing(spark, tmp_path):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x"}
    (tmp_path / "a b.ts").write_text("x")
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, env=env)
    assert [r.path for r in S.tracked_files(spark, str(tmp_path)).collect()] == ["a b.ts"] and len(S.head_commit(str(tmp_path))) == 40


def test_upserts(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, v long")
    assert {tuple(r) for r in upsert(df(("a", 1), ("b", 2)), df(("b", 9), ("c", 3)), ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    assert {tuple(r) for r in insert_new(df(("a", 1), ("b", 2)), df(("b", 9), ("c", 3)), ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_index_pipeline(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}")
    repo = store.register("/code/x", "x", "git@host.org:Team/X.git")
    assert store.register("/elsewhere", "x", "https://host.org/team/x") == repo and store.repos().count() == 1
    assert store.find("/code/x/").first().name == "x"
    rows = [("src/a.ts", "typescript", "import { b } from './b';\nexport const a = b"), ("src/b.ts", "typescript", "export const b = 1")]
    contents = spark.createDataFrame(rows, "path string, language string, content string")
    assert store.index(repo, contents, "c1", commits(spark), AS_OF) == "indexed" and store.index(repo, contents, "c1") == "skipped"
    assert [tuple(r) for r in store.read("file_imports", repo).collect()] == [(repo, "src/a.ts", "src/b.ts")]
    assert store.read("file_stats", repo).count() == 3 and store.read("file_cochanges", repo).count() == 3
    store.index(repo, contents.filter("path = 'src/b.ts'"), "c2")
    assert [r.path for r in store.read("file_metadata", repo).collect()] == ["src/b.ts"] and store.read("file_imports", repo).count() == 0
    assert store.repos().first().index_status == "ready"
    store.remove(repo)
    assert store.repos().count() == 0 and store.read("file_metadata", repo).count() == 0


def test_graph_properties(spark):
    pairs = spark.createDataFrame([("a", "b", 3), ("a", "c", 5), ("b", "c", 1)], "path_a string, path_b string, cochange_count bigint")
    both = {tuple(r) for r in graph.symmetric(pairs).collect()}
    assert both == {(b, a, n) for a, b, n in both} and len(both) == 6
    assert [(r.partner, r["rank"]) for r in graph.partners(pairs, 1).filter("path = 'a'").collect()] == [("c", 1)]
    files = spark.createDataFrame([("a", "x"), ("b", "x")], "path string, language string")
    imports = spark.createDataFrame([("b", "a")], "source_path string, target_path string")
    stats = spark.createDataFrame([], "path string, commit_count bigint, recent_count bigint")
    near = graph.neighbours(files, imports, stats, pairs, "a").collect()
    assert sorted((r.kind, r.path) for r in near) == [("cochange", "b"), ("cochange", "c"), ("imported_by", "b"), ("self", "a")]
    assert graph.neighbours(files, imports, stats, pairs, "b", one_sided=True).filter("kind = 'cochange'").count() == 1
    assert graph.neighbours(files, imports, stats, pairs, "zzz").count() == 0


def test_layers(spark, tmp_path):
    count = iter(range(999))

    def table(df):
        path = str(tmp_path / f"t{next(count)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("e", "f"), ("f", "e"), ("g", "g"), ("x", "a")], "source_path string, target_path string")
    got = {r.path: r.layer for r in layout.layers(nodes, edges, table).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "g": 0, "e": 2, "f": 2}
    assert all(r.place <= 1 for r in layout.placed(layout.layers(nodes, edges, table), edges, 1).collect())


def test_coordinates(spark):
    rows = [(f"{layer}-{i}", layer, i, i + 1) for layer, n in ((0, 3), (1, 5), (3, 1)) for i in range(n)]
    got = {r.path: (r.x, r.y) for r in layout.coordinates(spark.createDataFrame(rows, "path string, layer int, degree long, place int"), 2).collect()}
    assert [got[f"0-{i}"] for i in range(3)] == [(-14.0, 0.0), (14.0, 0.0), (0.0, 28.0)]
    assert got["1-0"] == (-14.0, 118.0) and got["1-4"] == (0.0, 174.0) and got["3-0"] == (0.0, 270.0 + 28 + 56)


def span(i, trace, parent, start, duration=5.0, name="n", source="cli"):
    return (f"{trace}{i}", trace, None if parent is None else f"{trace}{parent}", name, source, start, duration)


SPAN = "span_id string, trace_id string, parent_span_id string, name string, source string, started_ms bigint, duration_ms double"


def test_traces(spark):
    rows = [span(0, "t", None, 100, 50.0, "root"), span(1, "t", 0, 110), span(2, "t", 1, 120), span(3, "u", 9, 7, 0.0), span(4, "u", 3, 7, None), span(5, "v", 6, 1), span(6, "v", 5, 1)]
    spans = spark.createDataFrame(rows, SPAN)
    assert {r.span_id: r.depth for r in traces.depths(spans).collect()} == {"t0": 0, "t1": 1, "t2": 2, "u3": 1, "u4": 2, "v5": None, "v6": None}
    rolled = {r.trace_id: r for r in traces.roll_up(spans).collect()}
    assert (rolled["t"].root_span_name, rolled["t"].started_ms, rolled["t"].ended_ms, rolled["t"].duration_ms) == ("root", 100, 150, 50.0)
    bars = {r.span_id: (r.left_percent, r.width_percent) for r in traces.waterfall(spans).collect()}
    assert bars["t0"] == (0.0, 100.0) and bars["t1"] == (20.0, 10.0) and bars["u3"] == (0.0, 2.0)
    old = traces.roll_up(spans.filter("span_id = 't0'"))
    new = traces.roll_up(spark.createDataFrame([span(8, "t", None, 100, 1.0, "late")], SPAN))
    assert traces.merged(old, new).first().root_span_name == "late"


def test_retention(spark):
    day = 86_400_000
    spans = spark.createDataFrame([span(0, "t", None, 9 * day), span(1, "u", None, day)], SPAN)
    logs = spark.createDataFrame([("t", None, "info", "x", 9 * day), ("u", None, "info", "x", day), (None, None, "info", "x", day)], "trace_id string, span_id string, level string, message string, timestamp_ms bigint")
    young, own, left = traces.kept(traces.roll_up(spans), spans, logs, 10 * day)
    assert [young.count(), own.count(), left.count()] == [1, 1, 1]


def test_streamed_traces_equal_batch(spark, tmp_path):
    rows = [span(i, f"t{i % 3}", None if i < 3 else i - 3, 1_700_000_000_000 + i) for i in range(12)]
    spans, source = spark.createDataFrame(rows, SPAN), str(tmp_path / "in")
    store = TraceStore(spark, str(tmp_path / "store"))
    for part in (spans.limit(5), spans, spans.limit(2)):  # rows come again
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).parquet(source)
        store.ingest(stream, "spans", str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(str, store.traces().collect())) == sorted(map(str, traces.roll_up(spans).collect()))
    assert store.spans().count() == 12
    unique = distinct_spans(spark.readStream.schema(SPAN).parquet(source))
    query = unique.writeStream.format("memory").queryName("unique_spans").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("unique_spans").count() == 12
    assert store.settled().count() == 0


def test_recorder(spark):
    rec = Recorder("cli")

    @rec.traced("inner")
    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError), rec.span("outer"):
        fails()
    got = {r.name: r for r in rec.frame(spark).collect()}
    assert got["inner"].parent_span_id == got["outer"].span_id and got["inner"].error_message == "no" and got["outer"].parent_span_id is None


def commit(root, message, date="2026-01-10T10:00:00+00:00"):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x", "GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date}
    for args in (["add", "-A"], ["commit", "-qm", message]):
        subprocess.run(["git", "-C", str(root), *args], check=True, env=env)


def test_incremental_indexing_from_git(spark, tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / "src/a.ts").write_text("import { b } from './b';\nexport const a = b")
    (root / "src/b.ts").write_text("export const b = 1")
    (root / "src/gone.ts").write_text("export const gone = 1")
    commit(root, "one")
    store = Catalog(spark, f"file://{tmp_path}/store")
    repo = store.register(str(root), "x")
    assert store.status("nobody") is None and store.status(repo).index_status == "pending"
    assert store.index_tree(repo, AS_OF) == "indexed" and store.index_tree(repo, AS_OF) == "skipped"
    exports = lambda: {r.path: list(r.exports) for r in store.read("file_metadata", repo).collect()}
    assert exports() == {"src/a.ts": ["a"], "src/b.ts": ["b"], "src/gone.ts": ["gone"]}
    (root / "src/b.ts").write_text("export const b = 1\nexport const more = 2")
    (root / "src/new é.ts").write_text("import './a'")
    (root / "src/gone.ts").unlink()
    commit(root, "two", "2026-01-20T10:00:00+00:00")
    assert store.index_tree(repo, AS_OF) == "indexed" and store.status(repo).index_status == "ready"
    assert exports() == {"src/a.ts": ["a"], "src/b.ts": ["b", "more"], "src/new é.ts": []}
    assert {(r.source_path, r.target_path) for r in store.read("file_imports", repo).collect()} == {("src/a.ts", "src/b.ts"), ("src/new é.ts", "src/a.ts")}
    stats = {r.path: (r.commit_count, r.last_modified) for r in store.read("file_stats", repo).collect()}
    assert stats["src/b.ts"] == (2, datetime(2026, 1, 20, 10)) and stats["src/a.ts"][0] == 1 and stats["src/gone.ts"][0] == 2
    pairs = {(r.path_a, r.path_b): r.cochange_count for r in store.read("file_cochanges", repo).collect()}
    assert pairs[("src/b.ts", "src/gone.ts")] == 2 and pairs[("src/a.ts", "src/b.ts")] == 1
    assert S.git_log(spark, str(tmp_path)).count() == 0
    # Files that should have symbols but none of which has any are all read anew.
    store.replace("file_metadata", repo, store.read("file_metadata", repo).withColumn("symbols", F.array().cast("array<struct<name:string,kind:string,line:int,exported:boolean>>")))
    assert store.index_tree(repo, AS_OF) == "indexed" and not store.needs_symbols(repo)


def test_a_log_is_cut_into_commits_by_its_marks(spark, tmp_path):
    h = ["%040x" % i for i in range(1, 400)]
    (tmp_path / "log.txt").write_text("".join(f"\x01{x}\0002026-01-10T10:00:00+00:00\n\nsrc/{x}.ts\nb\n" for x in h))
    rows = S.parse_log(spark, str(tmp_path / "log.txt")).collect()
    assert {(r.hash, tuple(r.files)) for r in rows} == {(x, (f"src/{x}.ts", "b")) for x in h}


def test_pairs_of_one_file_and_added_pairs(spark):
    changes = history.commit_files(commits(spark))
    both = history.cochanges(changes)
    own = {tuple(r) for r in history.cochanges_of(changes, "src/b.ts").collect()}
    assert own == {tuple(r) for r in both.filter("path_a = 'src/b.ts' or path_b = 'src/b.ts'").collect()} and own
    some = spark.createDataFrame([("src/a.ts",), ("src/c.ts",), ("none",)], "path string")
    assert {tuple(r) for r in history.cochanges_of(changes, some).collect()} == {tuple(r) for r in both.filter("path_a in ('src/a.ts', 'src/c.ts') or path_b in ('src/a.ts', 'src/c.ts')").collect()}
    assert {r.cochange_count for r in history.accumulate_pairs(both, both).collect()} == {2, 4}


def test_deep_traces_keep_the_plan_small(spark):
    rows = [span(i, "t", i - 1 if i else None, 1000 + i) for i in range(300)]
    deep = traces.depths(spark.createDataFrame(rows, SPAN))
    assert {r.span_id: r.depth for r in deep.collect()} == {f"t{i}": i for i in range(300)}
    assert deep._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 6


def test_bundle(spark):
    spans = spark.createDataFrame([span(0, "t", None, 5), span(1, "u", None, 6)], SPAN).withColumn("input", F.lit("i"))
    logs = spark.createDataFrame([("t", "t0", "info", "m", 4), ("z", None, "info", "m", 4)], "trace_id string, span_id string, level string, message string, timestamp_ms bigint")
    assert [(r.kind, r.at_ms, r.name, r.text) for r in traces.bundle(spans, logs, "t").collect()] == [("log", 4, "info", "m"), ("span", 5, "n", "i")]
    assert traces.bundle(spans, logs, "z").count() == 0


def test_chains_of_layers(spark, tmp_path):
    from codeatlas.shared import stored

    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(12)], "path string")
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(11)] + [("n00", "n05"), ("n03", "n09")], "source_path string, target_path string")
    assert {r.path: r.layer for r in layout.layers(nodes, edges, stored).collect()} == {f"n{i:02}": i for i in range(12)}


def test_printed_lines(spark):
    row = spark.createDataFrame([("a/b.ts", 3, " class A {\n}", {"N": "A"}, True, 1.005, ["x", "y", "z"])], "path string, line int, text string, captures map<string,string>, hub boolean, score double, who array<string>")
    c = F.col
    got = row.select(formats.match_line(c("path"), c("line"), c("text"), c("captures")), formats.result_line(c("path"), c("hub"), c("score"), c("who")), formats.padded(c("path"), 4), formats.padded(c("path"), 8)).first()
    assert list(got) == ["a/b.ts:3  class A {  [N=A]", "  a/b.ts [hub]  score=1.00 <- x, y" if got[1].endswith("1.00 <- x, y") else "  a/b.ts [hub]  score=1.01 <- x, y", "a/b.", "a/b.ts  "]
    assert [formats.match_count(*a) for a in ((0, False), (1, False), (2, True))] == ["0 matches", "1 match", "2 matches (truncated)"]


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Twice the commits have twice the partitions, so a task's pairs do not grow with them; numbers rank as their paths do."""
    from codeatlas.operators import graph, history

    monkeypatch.setattr(history, "TASK_PAIRS", 20)
    some = lambda n: spark.createDataFrame([(h, f"f{(h + k) % 9}.ts") for h in range(n) for k in range(5)], "hash long, path string")
    parts = [history.parts_for(some(n)) for n in (40, 80)]
    assert parts == [21, 41]
    assert history.cochanges(some(80)).rdd.getNumPartitions() == 41
    assert {r.cochange_count for r in history.cochanges(some(9)).collect()} == {1, 2, 3, 4}
    changes, names = history.numbered(some(40))
    name = {r.number: r.path for r in names.collect()}
    assert [name[n] for n in sorted(name)] == sorted(name.values())
    got = {(name[r.path], name[r.partner], r.cochange_count, r["rank"]) for r in graph.partners(history.cochanges(changes), 3, parts=7).collect()}
    assert got == {tuple(r) for r in graph.partners(history.cochanges(some(40)), 3).collect()}


def test_merged_and_accumulated_pairs_are_dealt(spark):
    """With a number of partitions, pairs merge and add up over so many tasks, to the same rows."""
    from codeatlas.operators import graph, history

    pairs = spark.createDataFrame([(f"a{i}", f"b{i % 7}", i) for i in range(40)], "path_a string, path_b string, cochange_count long")
    turned = pairs.selectExpr("path_b AS path_a", "path_a AS path_b", "cochange_count")
    summed = history.accumulate_pairs(pairs, pairs, 9)
    assert summed.rdd.getNumPartitions() == 9
    assert sorted(summed.collect()) == sorted(history.accumulate_pairs(pairs, pairs).collect())
    got = graph.merge_pairs(pairs.filter("cochange_count >= 20"), turned, 9)
    assert sorted(got.collect()) == sorted(pairs.collect())


def test_edges_are_dealt_by_the_lines(spark, monkeypatch):
    """Both joins of edges with paths have as many tasks as the lines ask for, whatever the session's number is, to the same rows."""
    from codeatlas.plans import bindings as B

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(B.imports(spark, "/root/testdata/sf0.001").collect())
        monkeypatch.setattr(B, "TASK_ITEMS", 500)
        got = B.imports(spark, "/root/testdata/sf0.001")
        n = -(-B.n_items(spark, "/root/testdata/sf0.001") // 500)
        assert n > 10 and got.rdd.getNumPartitions() == n
        assert sorted(got.collect()) == want and want
        monkeypatch.setattr(B, "TASK_ITEMS", 5_000)
        assert B.imports(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_layers_deal_their_edges(spark):
    """With a number of partitions, the edges of a round are dealt to so many tasks, to the same layers."""
    from codeatlas.shared import stored

    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(12)], "path string")
    edges = spark.createDataFrame([(f"n{i:02}", f"n{j:02}") for i in range(10) for j in range(i, 12, 3)] + [("n11", "n10"), ("n10", "n11")], "source_path string, target_path string")
    names = []

    def table(df):
        if "target_path" in df.columns:
            names.append(df.rdd.getNumPartitions())
        return stored(df)

    got = sorted(layout.layers(nodes, edges, table, 9).collect())
    assert names and set(names) == {9}
    assert got == sorted(layout.layers(nodes, edges, stored).collect())
