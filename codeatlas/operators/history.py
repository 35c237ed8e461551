"""Commit history: per-file statistics and pairs of files that change together."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored

MOST_FILES = 50
RECENT_DAYS = 90
#: Pairs that one task counts: some 300 MB of paths.
TASK_PAIRS = 750_000


def commit_files(commits: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """hash, ts, path for each distinct file of commits with at most most files; commits without a date are left out."""
    usable = commits.filter(F.col("ts").isNotNull()).withColumn("files", F.array_distinct("files"))
    return usable.filter(F.size("files") <= most).select("hash", "ts", F.explode("files").alias("path"))


def file_stats(changes: DataFrame, as_of: datetime | Column, days: int = RECENT_DAYS) -> DataFrame:
    """path, commit_count, recent_count (in the days before as_of, both ends included) and last_modified from hash, ts, path rows."""
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    recent = F.col("ts") >= end - F.make_dt_interval(F.lit(days))
    return changes.groupBy("path").agg(F.count(F.lit(1)).alias("commit_count"), F.count(F.when(recent, 1)).alias("recent_count"), F.max("ts").alias("last_modified"))


def parts_for(changes: DataFrame) -> int:
    """Partitions for the pairs of hash, path rows, about TASK_PAIRS to each: their number goes with the commits, so a task's memory does not."""
    sizes = changes.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    return max(changes.sparkSession.sparkContext.defaultParallelism, int(max(row["rows"] or 0, row["pairs"] or 0)) // TASK_PAIRS + 1)


def cochanges(changes: DataFrame, parts: int | None = None) -> DataFrame:
    """path_a < path_b and cochange_count, the commits that hold both, from hash, path rows.

    A commit's files are few, so its pairs are made where they meet. Commits and pairs are dealt to parts partitions
    (none given: to parts_for() of them, which runs changes once for the count).
    """
    parts = parts or parts_for(changes)
    files = changes.repartition(parts, "hash").groupBy("hash").agg(F.sort_array(F.collect_set("path")).alias("files"))
    pairs = F.flatten(F.transform("files", lambda a, i: F.transform(F.slice("files", i + 2, F.size("files")), lambda b: F.struct(a.alias("path_a"), b.alias("path_b")))))
    dealt = files.filter(F.size("files") > 1).select(F.explode(pairs).alias("p")).select("p.path_a", "p.path_b").repartition(parts, "path_a", "path_b")
    return dealt.groupBy("path_a", "path_b").agg(F.count(F.lit(1)).alias("cochange_count"))


def numbered(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes (hash, path) with numbers for paths, and the table of path, number; numbers are in the order of paths, so that pairs and ranks need no texts."""
    names = stored(changes.select("path").distinct().orderBy("path").select("path", F.monotonically_increasing_id().alias("number")), "numbers")
    return changes.join(names, "path").select("hash", F.col("number").alias("path")), names


def grouped(changes: DataFrame) -> DataFrame:
    """hash, files of the commits of hash, path rows that hold several files: what pairs are made of."""
    return changes.groupBy("hash").agg(F.sort_array(F.collect_set("path")).alias("files")).filter(F.size("files") > 1)


def parts_of(commits: DataFrame) -> int:
    """Partitions for the pairs of grouped() commits from either end, about TASK_PAIRS pairs to each."""
    pairs = commits.agg(F.sum(F.size("files").cast("long") * (F.size("files") - 1) / 2)).first()[0]
    return int(pairs or 0) // TASK_PAIRS + 1


def beside(commits: DataFrame) -> DataFrame:
    """path, partners: each file of each of grouped() commits, with the others. A path travels once with all its partners in a commit."""
    rows = F.transform("files", lambda a: F.struct(a.alias("path"), F.filter("files", lambda b: b != a).alias("partners")))
    return commits.select(F.explode(rows).alias("r")).select("r.path", "r.partners")


def accumulate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of two ranges of commits as one; recent counts are those of new, for old ones have aged."""
    parts = old.withColumn("recent_count", F.lit(0).cast("long")).unionByName(new)
    return parts.groupBy("path").agg(F.sum("commit_count").alias("commit_count"), F.sum("recent_count").alias("recent_count"), F.max("last_modified").alias("last_modified"))


def cochanges_of(changes: DataFrame, paths: str | DataFrame) -> DataFrame:
    """The pairs of cochanges() that hold a file, or one of some files (column path), from the commits that they are in alone."""
    some = changes.sparkSession.createDataFrame([(paths,)], "path string") if isinstance(paths, str) else paths.select("path").distinct()
    own = changes.join(some, "path", "left_semi").select("hash").distinct()
    pairs = cochanges(stored(changes.join(own, "hash", "left_semi").select("hash", "path"), "own-commits"))
    marked = pairs
    for end in ("path_a", "path_b"):
        marked = marked.join(some.select(F.col("path").alias(f"__{end}")), F.col(end) == F.col(f"__{end}"), "left")
    return marked.filter(F.coalesce("__path_a", "__path_b").isNotNull()).select(pairs.columns)


def accumulate_pairs(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs of two ranges of commits as one; counts add up. The pairs are dealt to parts partitions if that is given."""
    both = old.unionByName(new)
    both = both.repartition(parts, "path_a", "path_b") if parts else both
    return both.groupBy("path_a", "path_b").agg(F.sum("cochange_count").alias("cochange_count"))
