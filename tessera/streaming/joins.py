"""Joins of two streams over an interval of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, by: str, within: str, late: str = "1 hour", how: str = "leftOuter") -> DataFrame:
    """(key, left_id, left_ts, right_id, right_ts): rows of one key whose right time is at most `within` after the left one.

    Both sides have a watermark, and the interval bounds how long either side is kept: a left row goes
    when no right row that is still allowed can follow it, and is then given out without a match if it
    had none; a right row goes when no left row can come before it. So the state holds the rows of about
    `within` and `late`, however long the streams run. Works on batches as well, without a watermark.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        df = df.withWatermark("ts", late) if df.isStreaming else df
        return df.select(F.col(by).alias(f"{name}_key"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))

    near = F.expr(f"right_key = left_key AND right_ts >= left_ts AND right_ts <= left_ts + INTERVAL {within}")
    return side(left, "left").join(side(right, "right"), near, how).select(F.col("left_key").alias("key"), "left_id", "left_ts", "right_id", "right_ts")
