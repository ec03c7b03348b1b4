"""Registered queries on patterns, frequent items and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.frequent import heavy_hitters
from tessera.operators.patterns import Step, match_rows
from tessera.operators.rollups import daily_sketches, distinct_users, exact_quantiles_of, rolled_up, shared_users, user_slices
from tessera.plans.registry import query
from tessera.sources.files import read_table

#: Views, perhaps an error, one to three clicks and a purchase, at most a day from one to the next.
FUNNEL = [Step(frozenset({"view"}), 1, None), Step(frozenset({"error"}), 0, 1), Step(frozenset({"click"}), 1, 3), Step(frozenset({"purchase"}))]
DAY = 86_400

ONE_IN = 200
SPACES = "[\\x20\\x09-\\x0D]+"


@query(f"""
WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL {DAY} SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS s, list(ts ORDER BY ts, event_id) AS times FROM n GROUP BY user_id, run),
p AS (SELECT user_id, times, k, length(regexp_extract(substr(s, 1, k), 'v+e?c{{1,3}}p$')) AS len FROM (SELECT *, unnest(range(1, length(s) + 1)) AS k FROM s) WHERE substr(s, k, 1) = 'p')
SELECT user_id, times[k - len + 1] AS begun, times[k] AS bought FROM p WHERE len > 0
""")
def purchase_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    found = match_rows(events, F.col("user_id"), F.col("ts"), F.col("event_type"), FUNNEL, DAY, [F.col("event_id")])
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select(F.col("key").cast("long").alias("user_id"), time(F.col("begin")).alias("begun"), time(F.col("end")).alias("bought"))


@query(f"""
WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '')) AS word FROM documents)
SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) * {ONE_IN} > (SELECT count(*) FROM w)
""")
def heavy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that are more than one in 200 of all words of all texts."""
    words = read_table(spark, sf_dir, "documents").select(F.explode(F.split("text", SPACES)).alias("word")).where("word <> ''")
    return heavy_hitters(words, "word", ONE_IN).select(F.col("item").alias("word"), "n")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def users_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by theta sketches of days, merged; exact, since no slice of users fills a sketch."""
    events = read_table(spark, sf_dir, "events")
    return distinct_users(daily_sketches(events, user_slices(events)), ["event_type"])


@query("""
WITH m AS (SELECT DISTINCT date_trunc('week', ts)::DATE AS week, user_id, event_type FROM events)
SELECT a.week, count(*) AS users FROM m a JOIN m b ON a.week = b.week AND a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' GROUP BY a.week
""")
def buyers_among_clickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a week who clicked and bought, by intersections of merged sketches, one for each slice of users."""
    events = read_table(spark, sf_dir, "events")
    days = daily_sketches(events, user_slices(events)).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    return shared_users(days, "week", "click", "purchase").where("users > 0")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (k >= 0.5 * n) AS half, min(value) FILTER (k >= 0.9 * n) AS most FROM r GROUP BY event_type
""")
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by KLL sketches of days, merged, and the exact ranks of the values within their error."""
    events = read_table(spark, sf_dir, "events")
    found = exact_quantiles_of(events, rolled_up(daily_sketches(events), ["event_type"]), [0.5, 0.9])
    of = lambda share: F.max(F.when(F.col("share") == share, F.col("quantile")))
    return found.groupBy("event_type").agg(of(0.5).alias("half"), of(0.9).alias("most"))
