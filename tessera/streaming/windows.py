"""Windowed counts of a stream of events; the batch form of each query is its check."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

#: Groups that keys are dealt over where Python keeps the state of many keys in one value.
BUCKETS = 128


def bucket(key: str, buckets: int) -> Column:
    """The group of a key; null keys have one of their own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, events): works on a batch and on a stream; a stream drops rows later than `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each event id, whatever is delivered twice within `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def closed_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, events): runs of a user's events with at most the gap between neighbours."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "events")


def milestones(events: DataFrame, every: int, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, milestone): a row whenever a user's events so far pass a multiple of `every`.

    The state of a user is one number, so it is the same however the stream is cut into batches. Users are
    dealt over buckets, whose number must not change over a stream's life; the numbers of a bucket's users are one
    value, so Python is called once for a bucket and batch.
    """

    def passed(key, frames, state):
        old = [np.frombuffer(bytes(x), np.int64) for x in state.get] if state.exists else [np.zeros(0, np.int64)] * 2
        seen = [np.unique(f["user_id"].to_numpy(np.int64), return_counts=True) for f in frames]
        users, of = np.unique(np.concatenate([old[0], *[u for u, _ in seen]]), return_inverse=True)
        before, now = np.zeros(len(users), np.int64), np.zeros(len(users), np.int64)
        before[of[: len(old[0])]] = old[1]
        np.add.at(now, of, np.concatenate([old[1], *[n for _, n in seen]]))
        state.update((users.tobytes(), now.tobytes()))
        n = now // every - before // every
        if n.any():
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            found = pd.array([None] * len(step) if key[0] < 0 else np.repeat(users, n), "Int64")
            yield pd.DataFrame({"user_id": found, "milestone": (np.repeat(before // every, n) + step) * every})

    rows = events.select(bucket("user_id", buckets).alias("bucket"), F.coalesce(F.col("user_id").cast("long"), F.lit(0).cast("long")).alias("user_id"))
    return rows.groupBy("bucket").applyInPandasWithState(passed, "user_id long, milestone long", "users binary, numbers binary", "append", GroupStateTimeout.NoTimeout)


def drain(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is final to Parquet files until the input is used up; a rerun goes on where it stopped."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
