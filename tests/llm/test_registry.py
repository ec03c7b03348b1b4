"""Every query of the subpackage that has SQL against it, and that all are there."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(found.fetchall())


def test_all_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {int(k[2:].split("_")[0]) for k in names if k.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
