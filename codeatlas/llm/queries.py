"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import audit, divergence, exact, gam, huffman, licenses, mixing, packing, quality, simhash, suffix, toxicity, urlrules
from .common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), texts=False)


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "huffman")
    huffman.write_tokens(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end=2)
    return huffman.read_tokens(spark, path, ids=False).withColumnRenamed("id", "doc_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end=1)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.score(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_simhash_groups, op3_exact_dedup, op4_repeated_strings, op5_huffman_ids, op6_license_scan, op7_packing, op8_url_rules, op9_toxicity, op10_source_mix,
        op11_quality_model, op12_filter_audit, op13_source_divergence, pipeline,
    )
}

ORACLES = {
    "op1_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        often AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        repeats AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM often) GROUP BY doc_id),
        lines AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
        marked AS (SELECT *, len(regexp_extract_all(line, '[#*$%&|<>]')) + len(regexp_extract_all(line, '!+')) AS marks,
            len(regexp_extract_all(line, '[|»•]')) + len(string_split(line, ' > ')) - 1 AS parts, len(regexp_extract_all(line, '\p{L}')) AS letters, len(regexp_extract_all(line, '\p{Lu}')) AS uppers,
            len(regexp_extract_all(line, '(?:^|[\x20\x09-\x0D])(?:https?://|www\.)')) AS links, count(*) OVER (PARTITION BY doc_id, line) AS times
            FROM lines WHERE n > 0),
        judged AS (SELECT *, NOT (10 * marks >= 3 * n AND marks > 1 OR NOT regexp_matches(line, '[\p{L}\p{N}]') OR parts > 1 AND 10 * parts >= 2 * n
            OR n <= 20 AND (times > 2 OR regexp_matches(lower(line), '__FURNITURE__'))
            OR 2 * links > n OR letters >= 20 AND 10 * uppers > 7 * letters) AS passes FROM marked),
        per AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (NOT passes) AS n_lines_removed, coalesce(sum(n) FILTER (passes), 0)::BIGINT AS n_words_left FROM judged GROUP BY doc_id),
        base AS (SELECT doc_id, len(ws) AS n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_left, 0) AS n_words_left
            FROM w LEFT JOIN per USING (doc_id) LEFT JOIN repeats USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_words_left >= n_words AS kept, n_lines, n_lines_removed, n_words_left
        FROM base
    """.replace("__FURNITURE__", "|".join(quality.BOILERPLATE)),
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)
    """,
    "op12_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
            + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
        k AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f LEFT JOIN k USING (doc_id) GROUP BY part, mask),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        s AS (SELECT filter_order, step::INT AS step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
            coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))), 0)::INT AS gone FROM o, (SELECT unnest(range(1, 6)) AS step)),
        e AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & gone = 0 AND mask & bit = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & gone = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (mask & gone > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
            coalesce(sum(n_good) FILTER (mask & gone = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (mask & gone = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
            FROM g, s GROUP BY part, filter_order, step, bit, gone)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM e
    """,
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, kept.term, c.n AS own, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + v) AS p
            FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(total) + any_value(v)) AS q
            FROM c JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
        sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE own > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
