"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): neighbours are moved to the least node of each neighbourhood."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        moved = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, space: Workspace) -> DataFrame:
    """(node, component) for every node of a link; component is the least node that it reaches.

    Each round is stored in the workspace, so a lost executor costs one round and plans stay short. A node with very
    many links is summed before the shuffle; its join is split by Spark's skew handling. Null ends are no links,
    repeated links count once, and no links give no rows.
    """
    edges = space.stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    while True:
        edges = space.stored(_star(_star(edges, True), False))
        # done when every child has one parent and no parent is a child
        twice = edges.groupBy("u").count().where("count > 1").select("u")
        chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if twice.unionByName(chained).isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
