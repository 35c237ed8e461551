"""Every query by its name over one small table: its columns and types, and rows with null ids, long texts and repeats."""

import pytest

from codeatlas.llm import queries

DOC = ("doc_id", "bigint")
COLUMNS = {
    "op1_quality_rules": [DOC, ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")],
    "op2_simhash_groups": [DOC, ("fingerprint", "string"), ("component_id", "bigint")],
    "op3_exact_dedup": [DOC, ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")],
    "op4_repeated_strings": [DOC, ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op5_huffman_ids": [DOC, ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op6_license_scan": [DOC, ("n_notices", "bigint"), ("license", "string")],
    "op7_packing": [DOC, ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
    "op8_url_rules": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op9_toxicity": [DOC, ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op10_source_mix": [DOC, ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op11_quality_model": [DOC, ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op12_filter_audit": [("part", "string"), ("filter_order", "string"), ("step", "int"), *((c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))],
    "op13_source_divergence": [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")],
}


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    long = " ".join(f"w{i % 7919}" for i in range(300_000))
    odd = [(None, None, None, None, 0), (None, "same text", "en", None, 9), (None, "same text", "en", None, 9), (900, long, "en", "a", len(long)), (901, "x" * 1_000_000, "en", "b", 1_000_000)]
    docs = [r[:5] for r in rows] + odd
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 3 == 0)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "http://b.net/es/x", "<html>"), (None, None, None), (1, "http://b.net/es/x", "<html>")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, len(docs)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, tables, name):
    folder, n = tables
    out = queries.QUERIES[name](spark, folder)
    assert out.dtypes[: len(COLUMNS[name])] == COLUMNS[name]
    got = out.collect()
    if name == "op7_packing":
        assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and all(r.length > 0 for r in got)
        assert sum(r.length for r in got if r.doc_id == 900) == next(r.doc_tokens for r in got if r.doc_id == 900)
    elif name == "op12_filter_audit":
        assert len(got) == 600 * len({r.part for r in got}) and {r.part for r in got} == {"", "en"}
    elif name == "op13_source_divergence":
        assert {r.lang for r in got} == {"en"} and all(r.value >= 0 for r in got)  # the null lang has one source, which is no pair
    else:
        assert len(got) == (3 if name == "op8_url_rules" else n)
