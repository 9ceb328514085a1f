"""Connected components over a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.sources.scratch import materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `root` for every node of a link between different nodes; `root` is the smallest node it reaches.

    Large and small stars in turn: a node's larger neighbours, then its smaller
    ones, are hung on its smallest neighbour until nothing changes. Nodes with
    many neighbours are joined like any skewed key.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "small-star")
        # Every node hangs on one root when the stars no longer change.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
