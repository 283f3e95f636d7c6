"""Connected components by alternating stars: minima and joins, never pairs of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged


def _settled(edges: DataFrame) -> bool:
    """The edges are stars: no larger end has two, no smaller end is another's larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.filter((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of the undirected edges ``u, v``.

    The component is the smallest node.  A round links every larger neighbour to the
    smallest one, then every node's smaller neighbours; the number of rounds is
    logarithmic in the longest path.  Ends when only stars are left.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = staged(edges.select(u, v).filter("u <> v").distinct(), "edges")
    while not _settled(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = staged(small.filter("u <> v").distinct(), "edges")
    hubs = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs)
