"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v; keeps a star around each node's least neighbour."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Columns node, group (the least node of its component), for the nodes of links (a, b).

    Each round writes its edges to the shared folder, which cuts the lineage. The
    number of rounds grows with the logarithm of the largest component's size.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while True:
        # Every edge points at a node that points nowhere and each node has one edge: stars only.
        open_ = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        if not open_ and edges.count() == edges.select("u").distinct().count():
            break
        following = materialise(_stars(_stars(edges, True), False), "edges")
        discard(edges)
        edges = following
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())
