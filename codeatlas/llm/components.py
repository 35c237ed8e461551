"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the ends of edges (columns u, v; one comparable type) by their component's smallest end.

    Returns node, label for every end. Alternates large-star and small-star steps: each joins
    every node to the smallest neighbour it knows, and a graph of n nodes is all stars after
    about log(n) rounds. A node's minimum is found with partial aggregation, and the join back
    to its neighbours is split when one node has very many. Each round is cut by a table in
    the shared folder. Null ends and loops are dropped.
    """

    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame) -> DataFrame:
        """Join u's neighbours v and u itself to the smallest of them."""
        least = e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return e.join(least, "u")

    edges = stored(edges.select("u", "v").filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "edges")
    nodes = stored(both_ways(edges).select(F.col("u").alias("node")).distinct(), "nodes")
    before = None
    while True:
        large = star(both_ways(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small, "stars")
        after = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            break
        before = after
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("label"))
