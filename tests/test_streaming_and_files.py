import pytest
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats_keep_values_and_types(spark, tmp_path, kind):
    df = spark.range(5).select("id", F.when(F.col("id") > 0, F.concat(F.lit('q"\n,'), "id")).alias("s"), F.expr("timestamp_ntz'2024-01-02 03:04:05.678901'").alias("ts"), (F.col("id") / 3).alias("d"))
    files.write(df, str(tmp_path / "t"), kind)
    options = {} if kind in files.TYPED else {"schema": df.schema}
    back = files.read(spark, str(tmp_path / "t"), kind, **options)
    assert dict(back.dtypes) == dict(df.dtypes) and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    if kind not in files.TYPED:
        with pytest.raises(ValueError):
            files.read(spark, str(tmp_path / "t"), kind)


def test_partitioned_write_prunes(spark, tmp_path):
    files.write(spark.range(100).withColumn("p", F.col("id") % 4), str(tmp_path / "t"), partition_by=("p",))
    plan = files.read(spark, str(tmp_path / "t")).where("p = 1")
    assert plan.count() == 25 and len(plan.inputFiles()) > 0 and "PartitionFilters: [isnotnull(p" in plan._jdf.queryExecution().executedPlan().toString()


def test_stream_gives_the_batch_result(spark, tmp_path):
    events = files.read_table(spark, SF, "events").repartitionByRange(4, "ts")
    files.write(events, str(tmp_path / "in"))
    stream = files.stream(spark, str(tmp_path / "in"), events.schema, files_per_batch=1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    windows.drain(windows.tumbling_counts(stream, late="40 days"), out, state)
    batch = {tuple(r) for r in windows.tumbling_counts(events).collect()}
    # append mode keeps windows that may still change; a late event closes them all
    closing = events.limit(1).withColumn("ts", F.expr("timestamp_ntz'2025-01-01 00:00:00'"))
    files.write(closing, str(tmp_path / "in"), mode="append")
    windows.drain(windows.tumbling_counts(stream, late="40 days"), out, state)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == batch


def test_stream_drops_what_is_delivered_twice(spark, tmp_path):
    events = files.read_table(spark, SF, "events").limit(200)
    files.write(events, str(tmp_path / "in"))
    files.write(events.limit(50), str(tmp_path / "in"), mode="append")
    stream = files.stream(spark, str(tmp_path / "in"), events.schema, files_per_batch=1)
    windows.drain(windows.first_seen(stream, late="60 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    assert windows.first_seen(files.read(spark, str(tmp_path / "in"))).count() == 200


def test_milestones_of_many_users_are_few_calls(spark, tmp_path):
    """Several batches; some users pass a milestone in each, some pass many at once; rows without a user count together."""
    users = [u for u in range(2000) for _ in range(u % 9)] + [7] * 950 + [None] * 45 + [-3] * 20
    events = spark.createDataFrame([(u, k) for k, u in enumerate(users)], "user_id long, event_id long")
    for k in range(3):
        files.write(events.where(F.col("event_id") % 3 == k), str(tmp_path / "in"), mode="append")
    rows = windows.milestones(files.stream(spark, str(tmp_path / "in"), events.schema, files_per_batch=2), 4, buckets=8)
    query = windows.drain(rows, str(tmp_path / "out"), str(tmp_path / "state"))
    want = sorted(((u, m) for u in set(users) for m in range(4, users.count(u) + 1, 4)), key=str)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want
    assert len(query.recentProgress) > 1 and max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 9
