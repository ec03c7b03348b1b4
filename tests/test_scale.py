import glob
import itertools
import math
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators.graph import directed, triangles, undirected
from tessera.operators.quantiles import exact_quantiles
from tessera.sources.layout import files_for, with_places, write_clustered


def test_triangles_with_a_hub(spark):
    """A node that touches all others, loops, repeated and half-open edges."""
    rnd = random.Random(2)
    edges = [(0, k) for k in range(1, 300)] + [(rnd.randint(1, 299), rnd.randint(1, 299)) for _ in range(900)] + [(5, 5), (None, 3), (4, None), (7, 0)]
    known = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    near = {}
    for e in known:
        for x, y in (tuple(e), tuple(e)[::-1]):
            near.setdefault(x, set()).add(y)
    want = {}
    for x in near:
        n = sum(b in near[a] for a, b in itertools.combinations(near[x], 2))
        if n:
            want[x] = n
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r["node"]: r["triangles"] for r in triangles(df, "a", "b").collect()} == want
    most = directed(undirected(df, "a", "b")).groupBy("low").count().agg(F.max("count")).first()[0]
    assert most <= math.sqrt(2 * len(known)) < 300
    assert triangles(df.limit(0), "a", "b").collect() == []


def test_parts_follow_edges_and_wedges(spark, monkeypatch):
    """However few partitions the session has, a task joins about as many wedges as it may."""
    monkeypatch.setattr("tessera.operators.graph.ROWS_A_PART", 1000)
    rnd = random.Random(6)
    edges = spark.createDataFrame([(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(3000)], "a long, b long")
    found = triangles(edges, "a", "b")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    flow = directed(undirected(edges, "a", "b")).groupBy("low").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert all(int(n) >= flow / 1000 > 15 for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", plan)) and plan.count("RepartitionByExpression") == 4
    near = {}
    for x, y in {(min(e), max(e)) for e in edges.collect() if e[0] != e[1]}:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    want = {x: sum(b in near[a] for a, b in itertools.combinations(near[x], 2)) for x in near}
    assert {r["node"]: r["triangles"] for r in found.collect()} == {x: k for x, k in want.items() if k}


@pytest.mark.parametrize("bins", [8, 64])
def test_quantiles_of_any_values(spark, bins):
    rnd = random.Random(bins)
    groups = {
        "hot": [rnd.choice([1.5, 2.5, 1e300, -1e300, 5e-324, 0.0]) for _ in range(3000)],
        "spread": [rnd.uniform(-1, 1) * 10 ** rnd.randint(-300, 300) for _ in range(500)],
        None: [7.0] * 40,
        "few": [3.0, 1.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.999, 1.0]
    want = {(g, s): sorted(v)[max(1, math.ceil(len(v) * s)) - 1] for g, v in groups.items() for s in shares}
    assert {(r["by"], r["share"]): r["quantile"] for r in exact_quantiles(df, "g", "v", shares, bins).collect()} == want


def test_a_box_reads_few_row_groups(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    write_clustered(lines, f"{tmp_path}/z", ["l_shipdate", "l_partkey"], 64)
    back = spark.read.parquet(f"{tmp_path}/z")
    assert back.count() == lines.count() and back.exceptAll(lines).isEmpty()
    low, high = [lines.agg(F.expr(f"timestamp_micros(cast(percentile_approx(unix_micros(cast(l_shipdate AS timestamp)), {s}) AS long))")).first()[0] for s in (0.4, 0.5)]
    part_low, part_high = lines.agg(F.percentile_approx("l_partkey", [0.3, 0.4])).first()[0]
    read = all_ = 0
    for path in glob.glob(f"{tmp_path}/z/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            date, part = (meta.row_group(g).column(at[c]).statistics for c in ("l_shipdate", "l_partkey"))
            all_ += 1
            read += date.min <= high and date.max >= low and part.min <= part_high and part.max >= part_low
    assert all_ >= 60 and read <= 0.1 * all_
    box = F.col("l_shipdate").between(low, high) & F.col("l_partkey").between(part_low, part_high)
    assert back.where(box).count() == lines.where(box).count() > 0


def test_places_are_found_by_halving(spark):
    """As by a count of all cuts below, with nulls and few different values, and by nothing that visits every cut."""
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, rnd.gauss(0, 1e6)]), rnd.randint(0, 3)) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, a double, b long")
    placed = with_places(df, ["a", "b"])
    assert "lambda" not in placed._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: (r["__p0"], r["__p1"]) for r in placed.collect()}
    shares = [k / 256 for k in range(1, 256)]
    cuts = [sorted(set(c)) for c in df.agg(F.percentile_approx("a", shares, 10_000), F.percentile_approx(F.col("b").cast("double"), shares, 10_000)).first()]
    assert found == {i: (0 if a is None else sum(c < a for c in cuts[0]), sum(c < b for c in cuts[1])) for i, a, b in rows}


def test_a_box_reads_few_pages_of_a_file(spark, tmp_path):
    """A large table has few files, and one file is still skipped for the most part."""
    assert files_for(600_000, 2_000) == 64 and files_for(216_000_000, 2_000) == 216 and files_for(5_000, 2_000) == 2 and files_for(0, 2_000) == 1
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    write_clustered(lines, f"{tmp_path}/z", ["l_shipdate", "l_partkey"], 1, page=500)
    box = "l_shipdate >= TIMESTAMP_NTZ '1997-01-01' AND l_shipdate < TIMESTAMP_NTZ '1997-07-01' AND l_partkey < 200"
    back = spark.read.schema(lines.schema).parquet(f"{tmp_path}/z").where(box)
    found, scan = back.collect(), back._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert len(found) == lines.where(box).count() > 0
    assert scan.metrics().get("numOutputRows").get().value() < lines.count() / 4
