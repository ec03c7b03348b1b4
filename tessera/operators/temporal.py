"""Joins over time that Spark has no single operator for, composed of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], prefix: str = "right_") -> DataFrame:
    """Adds to each left row the values of the latest right row of its key at or before its time.

    Both sides go through one shuffle on the key and one sort: in their union, the last right
    row before a left one is a running aggregate, so pairs are never formed. At equal times a
    right row counts as earlier. Left rows with a null key or time, and those before the first
    right row, get nulls. Among right rows of one key and time the greatest values win.
    """
    packed = F.struct(F.col(on), *[F.col(v) for v in values])
    right_rows = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).groupBy(by, on).agg(F.max(packed).alias("__r"))
    rows = left.withColumn("__r", F.lit(None).cast(right_rows.schema["__r"].dataType)).withColumn("__left", F.lit(True))
    # rows that can match nothing are dealt over all tasks instead of meeting in one
    spread = F.when(F.col(by).isNull() | F.col(on).isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("__alone", spread)
    right_rows = right_rows.withColumn("__alone", F.lit(None).cast("long"))
    both = rows.unionByName(right_rows.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    order = W.partitionBy(by, "__alone").orderBy(F.col(on).asc_nulls_first(), "__left").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__last", F.last("__r", ignorenulls=True).over(order)).where("__left")
    known = F.col(by).isNotNull() & F.col(on).isNotNull()
    return found.select(*left.columns, *[F.when(known, F.col("__last")[v]).alias(prefix + v) for v in [on, *values]])


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs each point with the spans [start, end) that hold it; all three columns are whole numbers.

    Spans are dealt over bins of `width`, so the join is an equi-join on bins instead of a
    comparison of all pairs. Choose a width near the typical span: wider ones are copied into
    each bin they touch. Nulls and empty spans match nothing.
    """
    bin_ = lambda c: F.floor(F.col(c) / width).cast("long")
    held = spans.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(bin_(start), F.floor((F.col(end) - 1) / width).cast("long"))))
    joined = points.withColumn("__bin", bin_(at)).join(held, "__bin")
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def sessions(df: DataFrame, by: str, on: str, gap_seconds: int) -> DataFrame:
    """(by, start, end, events): runs of rows of a key with at most the gap between neighbours."""
    window = F.session_window(on, f"{gap_seconds} seconds")
    return df.groupBy(by, window.alias("w")).agg(F.min(on).alias("start"), F.max(on).alias("end"), F.count("*").alias("events")).drop("w")
