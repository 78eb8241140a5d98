"""Connected components by alternating star contraction, as Spark joins.

Each round points every node's larger neighbours at the smallest node it knows, then its
smaller ones; only per-node minima are gathered, so a node with any number of links costs
one row per task before the shuffle. Each round ends in a table in the shared folder; the
rounds end when the links are stars, which one aggregate tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node points at one other at most, and at none if others point at it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("hub"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("hub").alias("hub"))
    return nodes.filter("out + hub > 1").isEmpty()


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """``node, root`` for every node of a link; ``root`` is the smallest node reachable.

    Nodes are any type with an order; links with a null end or equal ends are ignored.
    """
    edges = written(
        links.filter(F.col(u) != F.col(v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct(),
        "edges",
    )
    while not _only_stars(edges):
        # Large star: every larger neighbour of a node to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "edges")
        # Small star: every smaller neighbour of a node, and the node, to the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
