import datetime as dt
import random

from tessera.operators.temporal import asof_join, range_join, sessions


def test_asof_join(spark):
    rnd = random.Random(1)
    key = lambda: rnd.choice([1, 2, 3, None])
    left = [(i, key(), rnd.choice([None, *range(30)])) for i in range(200)]
    right = [(key(), rnd.choice([None, *range(30)]), rnd.choice([None, 1, 2])) for _ in range(60)]
    out = asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", ["v"])
    want = set()
    for i, k, t in left:
        hits = [(b, -1 if v is None else v) for a, b, v in right if None not in (k, t, a, b) and a == k and b <= t]
        b, v = max(hits, default=(None, -1))
        want.add((i, k, t, b, None if v < 0 else v))
    assert {tuple(r) for r in out.collect()} == want and out.columns == ["id", "k", "t", "right_t", "right_v"]


def test_range_join(spark):
    rnd = random.Random(2)
    points = [(i, rnd.choice([None, *range(-50, 100)])) for i in range(150)]
    spans = [(i, rnd.randint(-60, 90), None) for i in range(40)]
    spans = [(i, a, rnd.choice([a, a + 1, a + 7, a + 45, None])) for i, a, _ in spans]
    out = range_join(spark.createDataFrame(points, "p int, at int"), spark.createDataFrame(spans, "s int, a int, b int"), "at", "a", "b", 7)
    want = sorted((p, s) for p, x in points for s, a, b in spans if None not in (x, b) and a <= x < b)
    assert sorted((r.p, r.s) for r in out.collect()) == want


def test_sessions(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(0)), (1, at(59)), (1, at(119)), (2, at(60)), (1, at(150)), (3, at(0)), (3, at(61))]
    out = sessions(spark.createDataFrame(rows, "u int, ts timestamp_ntz"), "u", "ts", 60)
    assert sorted((r.u, r.start, r.end, r.events) for r in out.collect()) == [(1, at(0), at(150), 4), (2, at(60), at(60), 1), (3, at(0), at(0), 1), (3, at(61), at(61), 1)]
