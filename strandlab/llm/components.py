"""Connected components of a table of links, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.session import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are hung on its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node and the node itself are hung on the smallest of them."""
    down = edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    moved = down.join(least, "x").select(F.col("m").alias("a"), F.explode(F.array("y", "x")).alias("b"))
    return moved.where("a < b").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each linked node reaches.

    Links are undirected and may repeat; links with a null end or of a node with itself are ignored. An empty table gives
    an empty table. The number of rounds grows with the logarithm of the longest path.
    """
    a, b = F.col(left), F.col(right)
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b and a is not null and b is not null").distinct()
    edges = materialise(edges, "links")
    mark = None
    while True:
        edges = materialise(_small(_large(edges)), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
