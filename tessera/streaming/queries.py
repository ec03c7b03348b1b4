"""Registered queries that run the event table as a stream, with the SQL of what the stream must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.files import read_table, stream
from tessera.sources.scratch import shared
from tessera.streaming.joins import interval_join
from tessera.streaming.timers import abandoned
from tessera.streaming.windows import closed_sessions, drain, first_seen, milestones, tumbling_counts


#: Files' worth of batches that the event table is delivered in, by time of arrival.
DELIVERIES, ROWS_A_FILE = 4, 1_000_000
#: One event in LATE arrives LATENESS minutes late, one in AGAIN arrives a second time so many minutes later; within what watermarks allow.
LATE, LATENESS, AGAIN, LATER = 5, 40, 10, 30


def delivered(spark: SparkSession, sf_dir: str, folder: str, repeats: bool = False, deliveries: int = DELIVERIES) -> DataFrame:
    """The event table as a stream of several deliveries of files, with late events and, if asked for, repeated ones."""
    events = read_table(spark, sf_dir, "events")
    minutes = F.when(F.col("event_id") % LATE == 0, LATENESS).otherwise(0).cast("long")
    rows = events.withColumn("__minutes", minutes)
    if repeats:
        rows = rows.unionByName(events.where(F.col("event_id") % AGAIN == 0).withColumn("__minutes", minutes + LATER))
    rows = rows.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")) + F.col("__minutes") * 60_000_000)
    first, last, n = rows.agg(F.min("__at"), F.max("__at"), F.count("*")).first()
    files = max(1, -(-(n or 0) // (deliveries * ROWS_A_FILE)))
    span = max(1, ((last or 0) - (first or 0)) // deliveries + 1)
    for i in range(deliveries):  # one after the other, since a stream takes files by their age
        part = rows.where(F.floor((F.col("__at") - (first or 0)) / span) == i).select(*events.columns)
        part.repartition(files).write.parquet(f"{folder}/delivery-{i}")
    return stream(spark, f"{folder}/delivery-*", events.schema, files_per_batch=files)


def streamed(spark: SparkSession, sf_dir: str, transform, repeats: bool = False) -> DataFrame:
    """What a stream of the event table appends until its input is used up."""
    out = shared(spark, "stream")
    result = transform(delivered(spark, sf_dir, f"{out}/in", repeats))
    drain(result, f"{out}/rows", f"{out}/state")
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


@query("""
SELECT start, event_type, count(*) AS events FROM (SELECT date_trunc('day', ts) AS start, event_type FROM events)
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY start, event_type
""")
def stream_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; the last ones stay open."""
    return streamed(spark, sf_dir, tumbling_counts).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, though some are delivered twice."""
    return streamed(spark, sf_dir, lambda rows: first_seen(rows).select("event_id", "user_id", "event_type"), repeats=True)


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    return streamed(spark, sf_dir, closed_sessions).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, unnest(range(20, n + 1, 20)) AS milestone FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def stream_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, lambda rows: milestones(rows, 20))


@query("""
WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 12 HOUR
WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 12 HOUR <= least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR
""")
def stream_clicks_to_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined over an interval: clicks with the purchases of the next twelve hours, and clicks that are certain to have none."""

    def joined(rows: DataFrame) -> DataFrame:
        return interval_join(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), "user_id", "12 hours").select(F.col("left_id").alias("click_id"), F.col("right_id").alias("purchase_id"))

    return streamed(spark, sf_dir, joined)


@query("""
WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT c.user_id, c.event_id AS click_id, c.ts + INTERVAL 6 HOUR AS given_up FROM c
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR)
    AND c.ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events WHERE event_type IN ('click', 'purchase')) - INTERVAL 1 HOUR
""")
def stream_abandoned_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks without a purchase within six hours, given out by timers."""
    return streamed(spark, sf_dir, abandoned).withColumn("given_up", F.timestamp_micros("given_up").cast("timestamp_ntz"))
