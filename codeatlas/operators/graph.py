"""Views of the import and co-change graphs: degrees, partners, summary, detail, overview, neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def indegrees(imports: DataFrame) -> DataFrame:
    """path, indegree of every file that is imported."""
    return imports.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("indegree"))


def max_indegree(imports: DataFrame, least: int = 0) -> DataFrame:
    """One row, most: the largest indegree of all files, at least least."""
    return indegrees(imports).agg(F.greatest(F.lit(least), F.coalesce(F.max("indegree"), F.lit(0))).alias("most"))


def symmetric(cochanges: DataFrame) -> DataFrame:
    """path, partner, cochange_count in both directions, so that one equality finds all partners."""
    ways = F.array(*(F.struct(F.col(a).alias("path"), F.col(b).alias("partner")) for a, b in (("path_a", "path_b"), ("path_b", "path_a"))))
    return cochanges.select(F.explode(ways).alias("way"), "cochange_count").select("way.path", "way.partner", "cochange_count")


def partner_of(path: Column) -> Column:
    """The other end of a pair."""
    return F.when(F.col("path_a") == path, F.col("path_b")).otherwise(F.col("path_a"))


def partners(cochanges: DataFrame, k: int = 10, only: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The k strongest co-change partners of each file (of those in only, column path): path, partner, cochange_count, rank. Files are dealt to parts partitions if that is given."""
    both = symmetric(cochanges)
    both = both.repartition(parts, "path") if parts else both
    both = both.join(only.select("path").distinct(), "path", "left_semi") if only is not None else both
    return ranked_partners(both, k)


def ranked_partners(both: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest partners of each file among pairs that are there from either end (path, partner, cochange_count)."""
    order = Window.partitionBy("path").orderBy(F.desc("cochange_count"), "partner")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_degrees(files: DataFrame, imports: DataFrame, stats: DataFrame) -> DataFrame:
    """files with indegree, hub_score (by the largest indegree of all), is_hub, commit_count and recent_count; missing ones are 0."""
    degree = indegrees(imports).withColumnRenamed("path", "__d")
    known = stats.select(F.col("path").alias("__s"), "commit_count", "recent_count")
    out = files.join(degree, F.col("path") == F.col("__d"), "left").join(known, F.col("path") == F.col("__s"), "left").drop("__d", "__s")
    out = out.crossJoin(F.broadcast(max_indegree(imports, 1)))  # one row
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("indegree", "commit_count", "recent_count")})
    return out.withColumns({"hub_score": F.least(F.lit(1.0), F.col("indegree") / F.col("most")), "is_hub": F.col("indegree") >= 5}).drop("most")


def cluster_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy(X.cluster_key(F.col("path")).alias("cluster")).agg(F.count(F.lit(1)).alias("file_count"))


def cluster_edges(imports: DataFrame) -> DataFrame:
    """Imports between clusters, both directions together: source (the smaller), target, weight."""
    ends = imports.select(X.cluster_key(F.col("source_path")).alias("a"), X.cluster_key(F.col("target_path")).alias("b")).filter("a <> b")
    return ends.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.count(F.lit(1)).alias("weight"))


def summary(files: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cluster_sizes(files), cluster_edges(imports)


def in_dir(files: DataFrame, prefix: str, whole_segments: bool = False) -> DataFrame:
    """Files whose path starts with prefix; with whole_segments it must end at a slash."""
    return files.filter(F.col("path").startswith(prefix.rstrip("/") + "/" if whole_segments and prefix else prefix))


def _ends(edges: DataFrame, a: str, b: str, paths: DataFrame, both: bool) -> DataFrame:
    """Edges with both ends, or at least one, among paths (column path)."""
    marked = edges
    for end in (a, b):
        mark = paths.select(F.col("path").alias(f"__{end}"))
        if both:
            marked = marked.join(mark, F.col(end) == F.col(f"__{end}"), "left_semi")
        else:
            marked = marked.join(mark, F.col(end) == F.col(f"__{end}"), "left")
    return marked if both else marked.filter(F.col(f"__{a}").isNotNull() | F.col(f"__{b}").isNotNull()).select(edges.columns)


def detail(files: DataFrame, imports: DataFrame, stats: DataFrame, cochanges: DataFrame, prefix: str, served_symbols: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files below prefix, and the imports and co-changes that touch one of them."""
    inside = in_dir(files, prefix)
    rows = with_degrees(inside, imports, stats).withColumn("symbols", F.slice("symbols", 1, served_symbols))
    paths = inside.select("path")
    return rows, _ends(imports, "source_path", "target_path", paths, both=False), _ends(cochanges, "path_a", "path_b", paths, both=False)


def overview(files: DataFrame, imports: DataFrame, stats: DataFrame, cochanges: DataFrame, prefix: str = "", limit: int = 5000, min_weight: int = 2) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The limit files of highest hub score below prefix, the imports and strong co-changes among them, and the count of all files there."""
    inside = in_dir(files, prefix)
    top = with_degrees(inside, imports, stats).orderBy(F.desc("hub_score"), "path").limit(limit)
    paths = top.select("path")
    strong = cochanges.filter(F.col("cochange_count") >= min_weight)
    return top, _ends(imports, "source_path", "target_path", paths, both=True), _ends(strong, "path_a", "path_b", paths, both=True), inside.agg(F.count(F.lit(1)).alias("total_files"))


def neighbours(files: DataFrame, imports: DataFrame, stats: DataFrame, cochanges: DataFrame, path: str, limit: int = 30, one_sided: bool = False) -> DataFrame:
    """What is one step from a file: kind (self, imports, imported_by, cochange), path, weight and the file's degrees.

    Empty for an unknown file. one_sided keeps only pairs whose first end is the file.
    """
    known = files.filter(F.col("path") == path)
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col("p").alias("path"), F.col("w").cast("long").alias("weight"))
    pairs = cochanges.filter((F.col("path_a") == path) if one_sided else (F.col("path_a") == path) | (F.col("path_b") == path))
    pairs = pairs.select(partner_of(F.lit(path)).alias("p"), F.col("cochange_count").alias("w")).orderBy(F.desc("w"), "p").limit(limit)
    rows = one("self", known.select(F.col("path").alias("p"), F.lit(None).alias("w")))
    rows = rows.unionByName(one("imports", imports.filter(F.col("source_path") == path).select(F.col("target_path").alias("p"), F.lit(None).alias("w"))))
    rows = rows.unionByName(one("imported_by", imports.filter(F.col("target_path") == path).select(F.col("source_path").alias("p"), F.lit(None).alias("w"))))
    rows = rows.unionByName(one("cochange", pairs))
    rows = rows.crossJoin(F.broadcast(known.select(F.lit(1).alias("__known"))))  # at most one row
    near = files.select("path", "language").join(rows.select("path").distinct(), "path", "left_semi")
    return rows.drop("__known").join(with_degrees(near, imports, stats), "path", "left")


def focus(imports: DataFrame, cochanges: DataFrame, path: str) -> DataFrame:
    """The paths to show with a file: itself, what it imports, its importers and all its partners."""
    ways = [
        imports.filter(F.col("source_path") == path).select(F.col("target_path").alias("path")),
        imports.filter(F.col("target_path") == path).select(F.col("source_path").alias("path")),
        cochanges.filter((F.col("path_a") == path) | (F.col("path_b") == path)).select(partner_of(F.lit(path)).alias("path")),
    ]
    out = imports.sparkSession.createDataFrame([(path,)], "path string")
    for way in ways:
        out = out.union(way)
    return out.distinct()


def visible(files: DataFrame, imports: DataFrame, cochanges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of the chosen types, and the edges and pairs that have both ends among them."""
    shown = files.filter(X.file_type(F.col("path")).isin(types))
    paths = shown.select("path")
    return shown, _ends(imports, "source_path", "target_path", paths, both=True), _ends(cochanges, "path_a", "path_b", paths, both=True)


def merge_pairs(base: DataFrame, more: DataFrame, parts: int | None = None) -> DataFrame:
    """base and those pairs of more that it lacks in either orientation. Pairs are dealt to parts partitions if that is given."""
    dealt = lambda df: df.repartition(parts, "path_a", "path_b") if parts else df
    ends = lambda df: dealt(df.select(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"), "cochange_count"))
    fresh = ends(more).groupBy("path_a", "path_b").agg(F.max("cochange_count").alias("cochange_count"))
    return ends(base).unionByName(fresh.join(ends(base), ["path_a", "path_b"], "left_anti"))


def presented(clusters: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters, largest first, and files, highest hub score first, in the order of a printed list."""
    return clusters.orderBy(F.desc("file_count"), "cluster"), files.orderBy(F.desc("hub_score"), "path")
