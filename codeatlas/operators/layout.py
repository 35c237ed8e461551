"""The relational part of the drawings: layers of the import graph, chains and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def layers(nodes: DataFrame, edges: DataFrame, table, parts: int | None = None) -> DataFrame:
    """path, layer by longest path from the files that nobody imports (edges: source_path imports target_path).

    Each round settles the files whose importers are all settled, and hands their layer to
    what they import; only edges of files that are not settled yet go on to the next round, and
    layers are written once. Files on cycles come after: one layer below their lowest settled
    importer, or in the middle without any. table stores a frame and reads it again, which cuts
    the lineage of each round; there is a round per layer. Edges are dealt to parts partitions if that is given.
    """
    paths = nodes.select("path")
    dealt = lambda rows, end: rows.repartition(parts, end) if parts else rows
    inside = edges.select("source_path", "target_path").filter("source_path <> target_path")
    for end in ("source_path", "target_path"):
        inside = dealt(inside, end).join(paths.withColumnRenamed("path", end), end, "left_semi")
    inside = table(inside.select("source_path", "target_path").distinct())
    imported = lambda: dealt(inside, "target_path").select(F.col("target_path").alias("path"))
    new = table(paths.join(imported(), "path", "left_anti").withColumn("layer", F.lit(0)))
    rest = table(paths.join(new, "path", "left_anti").withColumn("layer", F.lit(None).cast("int")))
    done = [new]
    while not rest.isEmpty():
        # What the files settled last hand on; rest keeps the best so far.
        handed = dealt(inside, "source_path").join(new.withColumnRenamed("path", "source_path"), "source_path").groupBy(F.col("target_path").alias("path")).agg((F.max("layer") + 1).alias("more"))
        inside = table(dealt(inside, "source_path").join(rest.select(F.col("path").alias("source_path")), "source_path", "left_semi"))
        rest = table(rest.join(handed, "path", "left").select("path", F.greatest("layer", "more").alias("layer")))
        new = table(rest.join(imported(), "path", "left_anti"))
        if new.isEmpty():
            middle = reduce(DataFrame.unionByName, done).agg(F.ceil(F.coalesce(F.max("layer"), F.lit(0)) / 2).cast("int").alias("middle"))
            done.append(rest.crossJoin(F.broadcast(middle)).select("path", F.coalesce("layer", "middle").alias("layer")))  # one row
            break
        done.append(new)
        rest = table(rest.join(new, "path", "left_anti"))
    return reduce(DataFrame.unionByName, done)


def placed(layered: DataFrame, imports: DataFrame, most: int = 40) -> DataFrame:
    """The most connected files of each layer, most of them at most: path, layer, degree, place (from 1)."""
    ends = imports.select(F.col("source_path").alias("path")).unionAll(imports.select(F.col("target_path").alias("path")))
    degree = ends.groupBy("path").agg(F.count(F.lit(1)).alias("degree"))
    rows = layered.join(degree, "path", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("degree"), "path"))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


#: How far layers, rows of a layer and files of a row are apart, and files in a row.
LAYER_HEIGHT, ROW_HEIGHT, SPACING, PER_ROW = 90, 28, 28, 40


def coordinates(rows: DataFrame, per_row: int = PER_ROW) -> DataFrame:
    """rows of placed() with x and y: a layer's files in rows of per_row, each row centred, layers from top to bottom and lower by the rows of those above.

    What a layer's rows come to is a table of a row per layer; only that is summed from layer to layer.
    """
    place = F.col("place") - 1
    sizes = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("size"))
    more = (F.ceil(F.col("size") / per_row) - 1) * ROW_HEIGHT
    above = F.coalesce(F.sum(more).over(Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sizes.withColumn("top", F.col("layer") * LAYER_HEIGHT + above)
    out = rows.join(F.broadcast(tops), "layer")  # a row per layer, of which there are no more than the longest chain of imports
    line = F.floor(place / per_row)
    wide = F.least(F.lit(per_row), F.col("size") - line * per_row) - 1
    return out.select(*rows.columns, ((place % per_row) * SPACING - wide * SPACING / 2).alias("x"), (F.col("top") + line * ROW_HEIGHT).cast("double").alias("y"))


def chains(files: DataFrame) -> DataFrame:
    """path, next_path: each file and the one after it in its directory, by path."""
    follows = F.lead("path").over(Window.partitionBy(X.dir_path(F.col("path"))).orderBy("path"))
    return files.select("path", follows.alias("next_path")).filter(F.col("next_path").isNotNull())


def heat_ranks(files: DataFrame, degrees: DataFrame) -> DataFrame:
    """path, folder, heat (indegree by the largest), and its rank in its folder."""
    rows = files.select("path").join(degrees, "path", "left").withColumn("indegree", F.coalesce("indegree", F.lit(0)))
    most = degrees.agg(F.greatest(F.lit(1), F.coalesce(F.max("indegree"), F.lit(1))).alias("most"))
    rows = rows.crossJoin(F.broadcast(most)).select("path", X.folder_key(F.col("path")).alias("folder"), (F.col("indegree") / F.col("most")).alias("heat"))  # one row
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("heat"), "path")))
