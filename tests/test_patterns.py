import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import rollups
from tessera.operators.frequent import heavy_hitters, trimmed
from tessera.operators.patterns import Automaton, Piece, Step, match_rows

SF = "/root/testdata/sf0.001"


def brute(rows, pattern, gap):
    """Every row against a regular expression over the symbols before it."""
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((t, i, s) for k, t, i, s in rows if k == key)
        begin = 0
        for n, (t, _, _) in enumerate(own):
            if n and t - own[n - 1][0] > gap:
                begin = n
            text = "".join(s for _, _, s in own[begin : n + 1])
            if m := re.search(f"(?:{pattern})$", text):
                out.append((str(key), own[begin + m.start()][0] * 1_000_000, t * 1_000_000))
    return sorted(out)


PATTERNS = [
    ("a+b?c{1,3}d", [Step(frozenset("a"), 1, None), Step(frozenset("b"), 0, 1), Step(frozenset("c"), 1, 3), Step(frozenset("d"))]),
    ("[ab]{2,3}a{0,2}[cd]", [Step(frozenset("ab"), 2, 3), Step(frozenset("a"), 0, 2), Step(frozenset("cd"))]),
    ("a{2,}[ab]{0,}b?", [Step(frozenset("a"), 2, None), Step(frozenset("ab"), 0, None), Step(frozenset("b"), 0, 1)]),
]


@pytest.mark.parametrize("pattern, steps", PATTERNS[:2])
@pytest.mark.parametrize("partitions", [1, 9])
def test_matches_of_long_and_short_keys(spark, pattern, steps, partitions):
    rnd = random.Random(partitions)
    rows, t = [], 0
    for i in range(1500):  # one key has most rows, and so many pieces
        t += rnd.choice([0, 1, 1, 2, 30])
        rows.append((7 if rnd.random() < 0.8 else rnd.randint(8, 40), t, i, rnd.choice("aaabbccd")))
    df = spark.createDataFrame(rows, "k long, t long, i long, s string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = match_rows(df, F.col("k"), F.timestamp_seconds("t"), F.col("s"), steps, 10, [F.col("i")])
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, pattern, 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("pattern, steps", PATTERNS)
def test_pieces_compose_wherever_they_are_cut(pattern, steps):
    rnd = random.Random(3)
    for _ in range(300):
        rows = [(k, rnd.choice("abcd")) for k in range(rnd.randint(1, 14))]
        cuts = sorted({0, len(rows), *(rnd.randint(0, len(rows)) for _ in range(3))})
        memory, found = [None] * Automaton(steps).size, []
        for i, j in zip(cuts, cuts[1:]):
            piece = Piece(Automaton(steps), 100)
            for at, s in rows[i:j]:
                piece.add(at, s)
            for end, own, came in piece.matches:
                starts = [memory[q] for q in came if memory[q] is not None] + [own] * (own is not None)
                found += [(min(starts), end)] if starts else []
            memory = piece.after(memory)
        want = [(b // 1_000_000, e // 1_000_000) for _, b, e in brute([(1, t, t, s) for t, s in rows], pattern, 100)]
        assert sorted(found) == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, "a"), (1, None, "a"), (1, 2, None), (1, 1, "a"), (1, 3, "b")], "k long, t long, s string")
    steps = [Step(frozenset("a")), Step(frozenset("b"))]
    assert [tuple(r) for r in match_rows(df, F.col("k"), F.timestamp_seconds("t"), F.col("s"), steps, 10).collect()] == [("1", 1_000_000, 3_000_000)]
    assert match_rows(df.limit(0), F.col("k"), F.timestamp_seconds("t"), F.col("s"), steps, 10).collect() == []


@pytest.mark.parametrize("fan", [2, 16])
def test_heavy_hitters(spark, fan):
    """Frequent items that are rare in each task but one, among many different values."""
    rnd = random.Random(fan)
    values = ["hot"] * 4000 + ["warm"] * 700 + ["mild"] * 480 + [f"v{rnd.randint(0, 4000)}" for _ in range(5000)] + [None] * 3000
    rnd.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(37)
    want = {v: n for v, n in Counter(v for v in values if v is not None).items() if n * 20 > len(values) - 3000}
    assert {r["item"]: r["n"] for r in heavy_hitters(df, "v", 20, fan).collect()} == want and len(want) == 2
    assert heavy_hitters(df.limit(0), "v", 20, fan).collect() == []
    numbers = spark.range(0, 9000, 1, 5).select((F.col("id") % 3).alias("v"))
    assert {r["item"]: r["n"] for r in heavy_hitters(numbers, "v", 4, fan).collect()} == {0: 3000, 1: 3000, 2: 3000}


def test_counters_are_bounded():
    import numpy as np
    import pyarrow as pa

    items, counts = trimmed(pa.array(list("abcdef")), np.array([9, 5, 5, 2, 1, 1]), 3)
    assert items.to_pylist() == ["a", "b", "c"] and counts.tolist() == [7, 3, 3]


def test_rank_errors_of_merged_sketches(spark):
    """Values by day in very different amounts and ranges; ranks of the merged sketch within its bound."""
    n = 200_000
    rows = spark.range(n).select(F.timestamp_seconds(F.col("id") * F.col("id") % 2_000_000).cast("timestamp_ntz").alias("ts"), F.lit("x").alias("event_type"), F.col("id").alias("user_id"), (F.pmod(F.xxhash64("id"), F.lit(n)) + 0.5).alias("value"))
    days = rollups.daily_sketches(rows)
    merged = rollups.rolled_up(days, ["event_type"])
    values = sorted(r[0] for r in rows.select("value").collect())
    shares = [0.01, 0.1, 0.5, 0.9, 0.99]
    found = merged.select(*[rollups.quantile(F.col("values"), s).alias(str(k)) for k, s in enumerate(shares)], F.theta_sketch_estimate("users").alias("users")).first()
    import bisect

    for k, s in enumerate(shares):
        low, high = bisect.bisect_left(values, found[k]) / n, bisect.bisect_right(values, found[k]) / n
        assert low - rollups.RANK_ERROR <= s <= high + rollups.RANK_ERROR
    assert abs(found["users"] - n) <= 5 * n / 2 ** (rollups.LG_ENTRIES / 2)
    assert days.count() > 10 and isinstance(days.first()["day"], dt.date)


def test_no_exact_count_in_the_plans_of_sketches(spark):
    from tessera.plans import patterns

    for f in (patterns.users_by_sketch, patterns.buyers_among_clickers):
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "theta" in plan.lower() and "count(" not in plan and "distinct" not in plan.lower()


@pytest.fixture
def many_users(spark, tmp_path):
    """Seven times the users that a sketch counts exactly, on a few days of two weeks."""
    rows = spark.range(60_000).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(1_704_067_200 + F.pmod(F.xxhash64("id"), F.lit(14)) * 86_400).cast("timestamp_ntz").alias("ts"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30_000)).alias("user_id"),
        F.element_at(F.array(F.lit("click"), F.lit("purchase"), F.lit("view")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50_000)) / 100).alias("value"),
    )
    rows.coalesce(2).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def beside_sql(spark, sf, name):
    import duckdb

    from tessera.plans import registry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, sf)
    found = con.execute(registry.ORACLE_SQL[name])
    return sorted(map(tuple, df.select(*[d[0] for d in found.description]).collect()), key=str), sorted(found.fetchall(), key=str)


def test_more_users_than_a_sketch_holds(spark, many_users):
    found, want = beside_sql(spark, many_users, "users_by_sketch")
    assert found == want and min(n for _, n in want) > 2 << rollups.LG_ENTRIES


def test_more_shared_users_than_a_sketch_holds(spark, many_users):
    found, want = beside_sql(spark, many_users, "buyers_among_clickers")
    assert found == want and min(n for _, n in want) > 500


def test_more_values_than_a_sketch_holds(spark, many_users):
    found, want = beside_sql(spark, many_users, "value_quantiles")
    assert found == want


def test_full_slices_are_an_error(spark, many_users):
    days = rollups.daily_sketches(spark.read.parquet(f"{many_users}/events.parquet"), 1)
    with pytest.raises(Exception, match="more slices"):
        rollups.distinct_users(days, ["event_type"]).collect()
    with pytest.raises(Exception, match="more slices"):
        rollups.shared_users(days.withColumn("all", F.lit(1)), "all", "click", "purchase").collect()
