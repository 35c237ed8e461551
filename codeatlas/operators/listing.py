"""Listings and counts over repositories and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import partners


def files_with_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """path, language, exports, import_count of every file; counts come before the join."""
    counts = imports.groupBy(F.col("source_path").alias("__p")).agg(F.count(F.lit(1)).alias("import_count"))
    out = files.join(counts, F.col("path") == F.col("__p"), "left")
    return out.select("path", "language", "exports", F.coalesce("import_count", F.lit(0)).alias("import_count"))


def page(files: DataFrame, imports: DataFrame, search: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the listing in path order, of the files whose path holds search; only its files meet their imports."""
    shown = (files.filter(X.like_path(F.col("path"), search)) if search else files).orderBy("path").offset(offset).limit(limit)
    own = imports.join(F.broadcast(shown.select(F.col("path").alias("source_path"))), "source_path", "left_semi")  # at most limit rows
    return files_with_imports(shown, own)


def page_total(files: DataFrame, search: str = "") -> DataFrame:
    """One row, total: how many files the pages of page() hold together."""
    shown = files.filter(X.like_path(F.col("path"), search)) if search else files
    return shown.agg(F.count(F.lit(1)).alias("total"))


def totals(files: DataFrame) -> DataFrame:
    """One row: n_files and n_repos."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("repo_id").alias("n_repos"))


def repo_counts(files: DataFrame) -> DataFrame:
    """repo_id, file_count."""
    return files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("file_count"))


def edges_per_repo(files: DataFrame, imports: DataFrame) -> DataFrame:
    """repo_id, edges: the imports that a repository's files make."""
    own = files.select(F.col("path").alias("source_path"), "repo_id")
    return imports.join(own, "source_path").groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"))


def symbol_files(files: DataFrame) -> DataFrame:
    """One row: eligible, the files whose language should have symbols, and with_symbols, the files of any language that have some."""
    return files.agg(F.count(F.when(F.col("language").isin("typescript", "javascript"), 1)).alias("eligible"), F.count(F.when(F.size("symbols") > 0, 1)).alias("with_symbols"))


def files_per_repo(repos: DataFrame, files: DataFrame) -> DataFrame:
    counts = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return repos.join(counts, repos["id"] == counts["repo_id"], "left").select(repos["*"], F.coalesce("n", F.lit(0)).alias("file_count"))


def languages(files: DataFrame) -> DataFrame:
    """language, file_count, largest first; files of unknown language are not shown."""
    return files.filter(F.col("language").isNotNull()).groupBy("language").agg(F.count(F.lit(1)).alias("file_count")).orderBy(F.desc("file_count"), "language")


def language_shares(files: DataFrame, top: int = 6) -> DataFrame:
    """The top languages and their rounded percentage of all files, those of unknown language included."""
    total = files.agg(F.count(F.lit(1)).alias("total"))
    return languages(files).limit(top).crossJoin(F.broadcast(total)).select("language", "file_count", F.floor(100 * F.col("file_count") / F.col("total") + 0.5).alias("percent"))  # one row


def file_types(files: DataFrame) -> DataFrame:
    return files.groupBy(X.file_type(F.col("path")).alias("file_type")).agg(F.count(F.lit(1)).alias("file_count")).orderBy(F.desc("file_count"), "file_type")


def file_document(files: DataFrame, imports: DataFrame, stats: DataFrame, cochanges: DataFrame, path: str, k: int = 20) -> DataFrame:
    """All that is known of one file: metadata, sorted imports and importers, statistics and its k strongest partners."""
    one = files.filter(F.col("path") == path)
    out_edges = imports.filter(F.col("source_path") == path).agg(F.sort_array(F.collect_set("target_path")).alias("import_paths"))
    in_edges = imports.filter(F.col("target_path") == path).agg(F.sort_array(F.collect_set("source_path")).alias("importers"))
    near = cochanges.filter((F.col("path_a") == path) | (F.col("path_b") == path))
    near = partners(near, k, one).agg(F.sort_array(F.collect_list(F.struct("rank", "partner", "cochange_count"))).alias("cochange_partners"))
    known = stats.filter(F.col("path") == path).select(F.col("path").alias("__p"), "commit_count", "recent_count", "last_modified")
    out = one.join(known, F.col("path") == F.col("__p"), "left").drop("__p")
    for single in (out_edges, in_edges, near):
        out = out.crossJoin(F.broadcast(single))  # one row each
    return out


def dominant_language(files: DataFrame) -> DataFrame:
    """cluster, language: the language that most files of a cluster have, the first by name on a tie."""
    counts = files.filter(F.col("language").isNotNull()).groupBy(X.cluster_key(F.col("path")).alias("cluster"), "language").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("best")).select("cluster", F.col("best.language").alias("language"))
