"""Connected components of a distributed edge list.

Alternating large-star and small-star steps: every node points its neighbours
to the smallest node it knows, until all edges are stars.  Each step is an
aggregation, which combines before the shuffle, and a join with its stored
result, one row a node.  As both sides of that join are dealt anew, Spark
splits partitions that a hub makes large; hubs of any degree are therefore no
single task's work.  Steps are cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v in every edge, as the large star leaves them."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up = 1 and down > 0").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` for every node of an edge; the root is the smallest node of its component.

    Loops and repeated edges are fine; edges with a null end are none; no edges give no rows.
    """
    ends = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b")
    edges = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(edges.distinct())
    if not edges.isEmpty():
        edges = cut(_small_star(cut(_large_star(edges))))
        while not _stars(edges):
            edges = cut(_small_star(cut(_large_star(edges))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
