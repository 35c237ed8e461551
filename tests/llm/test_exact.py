import hashlib
import re
from collections import defaultdict

import pytest

from codeatlas.llm import exact


def test_groups_match_brute_force(docs, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    got = exact.exact_groups(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: norm(r[1]) for r in rows}
    for g in got:
        same = groups[texts[g.doc_id]]
        assert (g.keep_id, g.group_size, g.text_sha256) == (min(same), len(same), hashlib.sha256(texts[g.doc_id].encode()).hexdigest())
    assert sum(g.kept for g in got) == len(groups) and all(g.doc_id == g.keep_id for g in got if g.kept)


def test_drop_copies_keeps_columns(docs, rows):
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})


def test_empty_and_null_ids(spark, empty):
    assert exact.exact_groups(empty).count() == 0
    got = exact.exact_groups(spark.createDataFrame([(None, "x"), (None, None), (3, "x")], "doc_id long, text string")).collect()
    assert sorted((g.doc_id is None, g.keep_id, g.group_size) for g in got if g.group_size == 2) == [(False, 3, 2), (True, 3, 2)]


def test_state_goes_on(spark, tmp_path):
    one = spark.createDataFrame([(5, "x"), (6, "y")], "doc_id long, text string")
    two = spark.createDataFrame([(2, "x"), (9, "y")], "doc_id long, text string")
    source, state, out = (str(tmp_path / n) for n in ("feed", "state", "out"))
    for part in (one, two):
        exact.feed(part).write.mode("append").parquet(source)
        states = exact.retain(spark.readStream.schema(exact.feed(part).schema).parquet(source), state, out)
    assert sorted((s["first"].id, s["group_size"]) for s in states.collect()) == [(2, 2), (6, 2)]


def test_one_of_repeated_rows_of_a_frame_in_memory_stays(spark):
    docs = spark.createDataFrame([(1, "x y", "p"), (1, "x  y", "q"), (1, "x y", "p"), (2, "z", "p"), (2, "z", "p")], "doc_id long, text string, file string")
    got = exact.exact_groups(docs).collect()
    assert sorted((g.doc_id, g.group_size, g.kept) for g in got) == [(1, 3, False), (1, 3, False), (1, 3, True), (2, 2, False), (2, 2, True)]
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]


@pytest.mark.parametrize("most", [0, 500_000])
def test_texts_with_a_forged_digest_stay_apart(docs, rows, monkeypatch, most):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "MOST_HITS", most)
    monkeypatch.setattr(exact, "digest_of", lambda text: F.substring(F.sha2(exact.normalised(text), 256), 1, 1))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    texts = {r[0]: norm(r[1]) for r in rows}
    got = exact.exact_groups(docs).collect()
    assert len(got) == len(rows) and sum(g.kept for g in got) == len(groups)
    for g in got:
        assert (g.keep_id, g.group_size) == (min(groups[texts[g.doc_id]]), len(groups[texts[g.doc_id]]))


def test_two_runs_with_one_state_compare_bytes(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    def table(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    state = str(tmp_path / "state")
    one = table("one", [(5, "x"), (6, "y"), (7, "w")])
    two = table("two", [(2, "x"), (9, "y"), (10, "v")])
    assert all(g.kept for g in exact.exact_groups(one, state=state).collect())
    got = {g.doc_id: (g.keep_id, g.group_size, g.kept) for g in exact.exact_groups(two, state=state).collect()}
    assert got == {2: (2, 2, True), 9: (6, 2, False), 10: (10, 1, True)}
    met = exact.earlier_texts(spark.createDataFrame([("d", (False, 6, *one.filter("doc_id = 6").select("_metadata.file_path", "_metadata.row_index").first()), 2)], "digest string, first struct<no_id:boolean,id:long,file:string,row:long>, group_size long"), exact.feed(two), "text")
    assert [tuple(r) for r in met.collect()] == [("d", "y")]
    monkeypatch.setattr(exact, "digest_of", lambda text: F.lit("same"))
    forged = str(tmp_path / "forged")
    exact.exact_groups(table("three", [(1, "a")]), state=forged)
    with pytest.raises(ValueError):
        exact.exact_groups(table("four", [(2, "b")]), state=forged)


def test_a_column_that_has_the_name_of_sparks_own(spark, tmp_path):
    rows = [(3, "same  text", "m"), (1, "same text", "n"), (2, None, "o"), (2, None, "o")]
    made = spark.createDataFrame(rows, "doc_id long, text string, _metadata string")
    made.coalesce(1).write.parquet(str(tmp_path / "docs"))
    for docs in (made, spark.read.parquet(str(tmp_path / "docs"))):
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect())
        assert got == [(1, 1, 2, True), (2, 2, 2, False), (2, 2, 2, True), (3, 1, 2, False)]
        left = exact.drop_copies(docs)
        assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(1, "same text", "n"), (2, None, "o")]
