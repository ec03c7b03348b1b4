"""What the queries leave in the shared folder: the table that their result is read from, and nothing else."""

import os

import pytest

import __spark_entry__ as entry
from tessera.llm import registry
from tessera.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def folders(spark):
    base = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(f"{base}/tessera")) if os.path.isdir(f"{base}/tessera") else set()


@pytest.mark.parametrize("name", [*registry.QUERIES, "pipeline"])
def test_only_the_result_stays(spark, name):
    before, tables = folders(spark), len(spark.catalog.listTables())
    assert entry.queries()[name](spark, SF).count() > 0
    left = folders(spark) - before
    assert len({x.rsplit("-", 1)[0] for x in left}) == len(left) <= 2, left
    assert len(spark.catalog.listTables()) - tables <= 1
