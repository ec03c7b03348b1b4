"""Each registered query against its SQL in DuckDB, on names, types and values."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(same(row[names.index(c)]) for c in sorted(names)) for row in found.fetchall()), key=str)
    assert sorted((tuple(same(r[c]) for c in sorted(names)) for r in df.collect()), key=str) == want


#: Queries whose rows are approximate, each with a test of its own.
APPROXIMATE = {"probable_neighbours"}


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) | APPROXIMATE


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["pricing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_orderkey" not in plan
