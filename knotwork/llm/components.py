"""Connected components of a graph that no machine could hold: alternating large-star and small-star rounds.

Each round is two shuffles of the edges; the number of rounds grows with the logarithm of the longest path. Every
round is written to the shared folder, so lineage stays short and lost executors cost no more than their own work.
A node of many edges is no one task's group: the smallest neighbour is a partial aggregate, and the join that hands it
to the other neighbours is one that Spark may split (skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import stored


def state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it. Edges have a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node that it can reach."""
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now = stored(edges.where("a <> b").select(*pair).distinct(), "edges")
    was = state(now)
    while was[0]:
        # a star forest stays as it is: no node has two parents, and no parent has one
        now = stored(small_star(large_star(now)), "edges")
        if (new := state(now)) == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
