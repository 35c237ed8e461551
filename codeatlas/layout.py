"""Relations laid out for their joins: tables bucketed and sorted by path, so that degrees, listings and partners meet without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, listing


class Layout:
    """The tables of one repository, bucketed by the path that they are joined on, under a root that all executors share.

    Edges are kept twice, by their source and by their target, and co-change pairs from either end, so that what is asked of a file
    lies where the file does. All tables have as many buckets: a join of two reads the same bucket of both, and
    an aggregation or a ranking by path stays within one. The session's catalog holds their names until drop().
    """

    TABLES = {"files": "path", "imports_by_source": "source_path", "imports_by_target": "target_path", "stats": "path", "partners": "path"}

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = 32) -> None:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a name for tables: {name}")
        self.spark, self.root, self.name, self.buckets = spark, root.rstrip("/"), name, buckets

    def write(self, files: DataFrame, imports: DataFrame, stats: DataFrame, cochanges: DataFrame, tables: tuple[str, ...] = tuple(TABLES)) -> None:
        """Write the tables, or some of them alone: what is asked of one needs no other to be worked out."""
        rows = {"files": files, "imports_by_source": imports, "imports_by_target": imports, "stats": stats, "partners": graph.symmetric(cochanges)}
        for table in tables:
            key = self.TABLES[table]
            dealt = rows[table].repartition(self.buckets, key)  # a bucket is written by one task, as one sorted file
            self._save(table, dealt, key)

    def _save(self, table: str, dealt: DataFrame, key: str) -> None:
        dealt.write.bucketBy(self.buckets, key).sortBy(key).mode("overwrite").option("path", f"{self.root}/{table}").saveAsTable(f"{self.name}_{table}")

    def write_numbered(self, beside: DataFrame, names: DataFrame) -> None:
        """Write partners from history.beside() with numbers for paths, and the table of number, path that tells their names.

        Numbers are in the order of paths, so ranks are the same. Pairs are dealt to their buckets once and counted there.
        """
        pairs = beside.repartition(self.buckets, "path").select("path", F.explode("partners").alias("partner"))
        self._save("partners", pairs.groupBy("path", "partner").agg(F.count(F.lit(1)).alias("cochange_count")), "path")
        self._save("names", names.select("number", "path").repartition(self.buckets, "number"), "number")

    def read(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def drop(self) -> None:
        """Forget the tables' names; their files stay under the root."""
        for table in (*self.TABLES, "names"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")

    def indegrees(self) -> DataFrame:
        return graph.indegrees(self.read("imports_by_target"))

    def files_with_imports(self) -> DataFrame:
        return listing.files_with_imports(self.read("files"), self.read("imports_by_source"))

    def with_degrees(self) -> DataFrame:
        return graph.with_degrees(self.read("files"), self.read("imports_by_target"), self.read("stats"))

    def partners(self, k: int = 10) -> DataFrame:
        return graph.ranked_partners(self.read("partners"), k)

    def named_partners(self, k: int = 10) -> DataFrame:
        """partners() of a layout with numbers for paths. The partners that are left are dealt by their numbers for their names."""
        rows = self.partners(k)
        for end in ("path", "partner"):
            rows = rows.join(self.read("names").select(F.col("number").alias(end), F.col("path").alias(f"{end}_name")), end)
        return rows.select(F.col("path_name").alias("path"), F.col("partner_name").alias("partner"), "cochange_count", "rank")
