"""Queries over the stream table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import exact, exact_sum, json_long
from tessera.operators.temporal import asof_join, range_join, sessions, top_k
from tessera.plans.registry import query
from tessera.sources.files import read_table
from tessera.streaming.windows import tumbling_counts


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY event_type")
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read_table(spark, sf_dir, "events").groupBy("event_type")
    return grouped.agg(F.count("*").alias("events"), F.sum(json_long("props", "k")).alias("k"), exact_sum("value").alias("value"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tumbling_counts(read_table(spark, sf_dir, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
SELECT start, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start
""")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return rows.select(F.col("w.start").alias("start"), "events")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM s GROUP BY user_id, n
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(read_table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600)


@query("""
SELECT c.event_id, p.event_id AS right_event_id, p.ts AS right_ts
FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts
""")
def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks, purchases = events.where("event_type = 'click'"), events.where("event_type = 'purchase'")
    return asof_join(clicks, purchases, "user_id", "ts", ["event_id"]).select("event_id", "right_event_id", "right_ts")


@query("""
SELECT a.event_id AS signup, b.event_id AS error FROM events a JOIN events b
ON a.event_type = 'signup' AND b.event_type = 'error' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 10 MINUTE
""")
def errors_after_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", at.alias("at"))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error"), "at")
    spans = events.where("event_type = 'signup'").select(F.col("event_id").alias("signup"), F.col("at").alias("start"), (F.col("at") + 600_000_000).alias("end"))
    return range_join(errors, spans, "at", "start", "end", 600_000_000).select("signup", "error")


@query("""
SELECT event_id, count(*) OVER w AS recent, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS recent_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
""")
def trailing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)
    events = read_table(spark, sf_dir, "events").withColumn("at", micros)
    return events.select("event_id", F.count("*").over(w).alias("recent"), F.sum(exact("value")).over(w).cast("double").alias("recent_value"))


@query("SELECT user_id, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS highest FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50 GROUP BY user_id")
def variant_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return read_table(spark, sf_dir, "events").withColumn("k", k).where("k > 50").groupBy("user_id").agg(F.max("k").alias("highest"))


@query("""
SELECT user_id, string_agg(event_type, '>' ORDER BY ts) AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events) WHERE k <= 5 GROUP BY user_id
""")
def first_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = top_k(read_table(spark, sf_dir, "events"), ["user_id"], ["ts"], 5)
    packed = F.array_sort(F.collect_list(F.struct("ts", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(packed, lambda x: x["event_type"]), ">").alias("path"))
