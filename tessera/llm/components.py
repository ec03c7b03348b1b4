"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

MOST_ROUNDS = 60


def are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other node, on which it is all there is above."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b); the root is the least node of its component.

    Each round hangs a node's larger neighbours on its least one (large star), then its smaller
    neighbours (small star), until only stars are left. The number of rounds grows with the
    logarithm of the diameter. Minima are combined before the shuffle, and every round is
    written to shared storage.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "edges")
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
