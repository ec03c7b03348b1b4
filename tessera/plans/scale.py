"""Registered queries on graphs, exact quantiles of large groups, and a clustered layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import parts_for, triangles
from tessera.operators.quantiles import exact_quantiles
from tessera.plans.registry import query
from tessera.sources.files import read_table
from tessera.sources.layout import files_for, write_clustered
from tessera.sources.scratch import shared

SHARES = [0.5, 0.9]
#: Rows of a stretch of the clustered layout, which is a file or a page of one.
ROWS_A_STRETCH = 2_000


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'),
e AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b)
SELECT part, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS part FROM t) GROUP BY part
""")
def parts_bought_in_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part, the triangles of parts of which each two were in one urgent order."""
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    parts = parts_for(spark, lines.count())
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey")).repartition(parts, "l_orderkey")
    lines = lines.select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey").join(urgent, "l_orderkey", "left_semi").distinct()
    edges = lines.withColumnRenamed("l_partkey", "a").join(lines.withColumnRenamed("l_partkey", "b"), "l_orderkey").where("a < b")
    return triangles(edges, "a", "b").withColumnRenamed("node", "part")


@query("""
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
s AS (SELECT unnest([0.5, 0.9]) AS share)
SELECT l_returnflag, CAST(share AS DOUBLE) AS share, min(v) FILTER (k >= CAST(share AS DOUBLE) * n) AS price FROM r CROSS JOIN s GROUP BY l_returnflag, share
""")
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_quantiles(read_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", SHARES)
    return found.select(F.col("by").alias("l_returnflag"), "share", F.col("quantile").alias("price"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01' AND l_partkey < (SELECT max(p_partkey) / 10 FROM part)
""")
def lines_in_a_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of half a year and a tenth of the parts, out of files along a curve over both."""
    lines, path = read_table(spark, sf_dir, "lineitem"), shared(spark, "clustered")
    write_clustered(lines, path, ["l_shipdate", "l_partkey"], files_for(lines.count(), ROWS_A_STRETCH), page=ROWS_A_STRETCH)
    most = read_table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0
    box = "l_shipdate >= TIMESTAMP_NTZ '1997-01-01' AND l_shipdate < TIMESTAMP_NTZ '1997-07-01'"
    found = spark.read.schema(lines.schema).parquet(path).where(box).where(F.col("l_partkey") < -(-most // 10))  # whole numbers, so that the scan is given it
    return found.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
