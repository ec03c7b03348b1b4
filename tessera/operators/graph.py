"""Triangles of a graph, by edges directed from nodes of lower to nodes of higher degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import written


#: Rows that a task sorts or groups, so that its memory does not grow with the graph.
ROWS_A_PART = 1 << 20


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows; not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PART))


def undirected(edges: DataFrame, a: str, b: str, parts: int | None = None) -> DataFrame:
    """(a, b): each edge once, without loops, repetitions and nulls."""
    rows = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(a).isNull() | F.col(b).isNull()).alias("open"))
    rows = rows.where("NOT open AND a <> b").select("a", "b")
    return (rows.repartition(parts, "a", "b") if parts else rows).distinct()


def directed(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(low, high): each edge from the end of lower degree, then smaller id; so no node has more than sqrt(2 * edges) behind it."""
    dealt = lambda df, by: df.repartition(parts, by) if parts else df
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    degrees = written(dealt(ends, "node").groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    of = lambda end: dealt(degrees.withColumnsRenamed({"node": end, "degree": f"d{end}"}), end)
    known = dealt(dealt(edges, "a").join(of("a"), "a"), "b").join(of("b"), "b")
    swap = F.struct("da", "a") > F.struct("db", "b")
    return known.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("low"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("high"))


def triangles(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, triangles) of the nodes that are in some triangle.

    A hub ends most of its edges, and begins few, so the wedges at any node are at most as many as the
    edges of the graph, and those of a hub are spread over its neighbours. Each triangle is found
    once, at its node of lowest degree. Wedges are counted on closing, never written. Edges and wedges are
    counted before they are dealt out, so a task sorts about ROWS_A_PART of them, whatever the graph.
    """
    spark = edges.sparkSession
    raw = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), "edges")
    once = written(undirected(raw, "a", "b", parts_for(spark, raw.count())), "undirected-edges")
    n = once.count()
    flow = written(directed(once, parts_for(spark, 2 * n)), "directed-edges")
    behind = flow.repartition(parts_for(spark, n), "low").groupBy("low").agg(F.count("*").alias("d"))
    parts = parts_for(spark, int(behind.agg(F.sum(F.expr("d * (d - 1) / 2"))).first()[0] or 0) + n)
    one, other = (flow.select("low", F.col("high").alias(x)).repartition(parts, "low") for x in ("x", "y"))
    wedges = one.join(other, "low").where("x < y").repartition(parts, "x", "y")
    closing = flow.select(F.least("low", "high").alias("x"), F.greatest("low", "high").alias("y")).repartition(parts, "x", "y")
    corners = wedges.join(closing, ["x", "y"]).select(F.explode(F.array("low", "x", "y")).alias("node"))
    return corners.groupBy("node").agg(F.count("*").alias("triangles"))
