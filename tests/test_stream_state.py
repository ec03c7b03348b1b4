import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.sources import files
from tessera.streaming import joins, queries, timers, windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def want(con, name):
    return sorted(con.execute(registry.ORACLE_SQL[name]).fetchall(), key=str)


@pytest.mark.parametrize("batches", [1, 7, 50])
def test_timers_do_not_depend_on_batches(spark, tmp_path, con, batches):
    rows = timers.abandoned(queries.delivered(spark, SF, f"{tmp_path}/in", deliveries=batches))
    windows.drain(rows, f"{tmp_path}/out", f"{tmp_path}/state")
    found = spark.read.parquet(f"{tmp_path}/out").select("user_id", "click_id", F.timestamp_micros("given_up").cast("timestamp_ntz"))
    assert sorted(map(tuple, found.collect()), key=str) == want(con, "stream_abandoned_clicks")


def test_timers_go_on_after_a_restart(spark, tmp_path, con):
    """The stream ends after each delivery and is started again from its checkpoint."""
    queries.delivered(spark, SF, f"{tmp_path}/all", deliveries=5)
    schema = files.read_table(spark, SF, "events").schema
    for i in range(5):
        files.write(spark.read.schema(schema).parquet(f"{tmp_path}/all/delivery-{i}"), f"{tmp_path}/in/d{i}")
        rows = timers.abandoned(files.stream(spark, f"{tmp_path}/in/d*", schema))
        windows.drain(rows, f"{tmp_path}/out", f"{tmp_path}/state")
    found = spark.read.parquet(f"{tmp_path}/out").select("user_id", "click_id", F.timestamp_micros("given_up").cast("timestamp_ntz"))
    assert sorted(map(tuple, found.collect()), key=str) == want(con, "stream_abandoned_clicks")


def test_many_users_are_few_calls(spark, tmp_path):
    """Python is called for a bucket and batch, not for a user; events without a user or time, and those that two users share a time with."""
    rows = [(u, u, k, t) for u in range(3000) for k, t in (("click", 10 * u % 7200),)] + [(10_000 + u, u, "purchase", 10 * u % 7200 + u % 3 * 21_600 - u % 2) for u in range(0, 3000, 2)]
    rows += [(20_000, None, "click", 5), (20_001, None, "purchase", 6), (20_002, 1, "click", None), (20_003, 2, "purchase", 400_000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t long").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    files.write(events.repartition(3), f"{tmp_path}/in")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/in/*.parquet'")
    query = windows.drain(timers.abandoned(files.stream(spark, f"{tmp_path}/in", events.schema), buckets=8), f"{tmp_path}/out", f"{tmp_path}/state")
    found = spark.read.parquet(f"{tmp_path}/out").select("user_id", "click_id", F.timestamp_micros("given_up").cast("timestamp_ntz"))
    expected = want(con, "stream_abandoned_clicks")
    assert sorted(map(tuple, found.collect()), key=str) == expected and 1500 < len(expected) < 3000
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress) < 100


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_the_state_of_an_interval_join_is_let_go(spark, tmp_path, con, how):
    events = queries.delivered(spark, SF, f"{tmp_path}/in", deliveries=10)
    rows = joins.interval_join(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "user_id", "12 hours", how=how)
    query = windows.drain(rows.select("left_id", "right_id"), f"{tmp_path}/out", f"{tmp_path}/state")
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert found == [r for r in want(con, "stream_clicks_to_purchases") if how == "leftOuter" or r[1] is not None]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    clicks = con.execute("SELECT count(*) FROM events WHERE event_type IN ('click', 'purchase')").fetchone()[0]
    assert held[-1] < max(held) < clicks / 3 and held[-1] < clicks / 20


def test_the_join_on_batches(spark, con):
    events = files.read_table(spark, SF, "events")
    rows = joins.interval_join(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "user_id", "12 hours", how="inner")
    found = sorted((tuple(r) for r in rows.select("left_id", "right_id").collect()), key=str)
    assert found == [r for r in want(con, "stream_clicks_to_purchases") if r[1] is not None]


def test_deliveries_have_late_and_repeated_events(spark, tmp_path):
    events = files.read_table(spark, "/root/testdata/sf0.01", "events")
    queries.delivered(spark, "/root/testdata/sf0.01", f"{tmp_path}/in", repeats=True)
    parts = [spark.read.parquet(f"{tmp_path}/in/delivery-{i}") for i in range(queries.DELIVERIES)]
    assert sum(p.count() for p in parts) > events.count() and all(p.count() for p in parts)
    bounds = [p.agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert any(b[0] < a[1] for a, b in zip(bounds, bounds[1:]))
