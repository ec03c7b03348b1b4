"""Queries with moments, maps, explosions and further joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import squared_length
from tessera.plans.registry import query
from tessera.sources.files import read_table


@query("SELECT n_name, s_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 9000")
def rich_suppliers_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read_table(spark, sf_dir, "supplier").where("s_acctbal > 9000")
    return rich.join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_name")


@query("""
SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
WHERE c_mktsegment = 'BUILDING'
""")
def latest_orders_of_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL form of a lateral top row; one aggregate over the orders of these customers gives the same without sorting."""
    builders = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = read_table(spark, sf_dir, "orders").join(builders, "o_custkey", "left_semi")
    latest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return latest.select(F.col("o_custkey").alias("c_custkey"), F.col("last.o_orderkey").alias("o_orderkey"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def dearest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query("""
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_quantity), 6) AS variance, round(corr(l_quantity, l_extendedprice), 6) AS correlation
FROM lineitem GROUP BY l_returnflag
""")
def quantity_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return grouped.agg(F.round(F.stddev_samp("l_quantity"), 6).alias("deviation"), F.round(F.var_pop("l_quantity"), 6).alias("variance"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"))


@query("""
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
WHERE n > 1 GROUP BY user_id
""")
def event_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each user, filtered by value and written out in the order of its keys."""
    each = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = each.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")).withColumn("m", F.map_filter("m", lambda _, n: n > 1))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.where(F.size("m") > 0).select("user_id", F.array_join(entries, ",").alias("counts"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(squared_length(F.col("embedding"))), 6).alias("norm"))


@query("SELECT user_id, round(regr_slope(value, event_id), 8) AS slope FROM events GROUP BY user_id HAVING count(*) > 1")
def value_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products that are combined before the shuffle, whatever a user's history holds."""
    grouped = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.regr_slope("value", "event_id").alias("slope"), F.count("*").alias("n"))
    return grouped.where("n > 1").select("user_id", F.round("slope", 8).alias("slope"))


@query("SELECT p_partkey, CAST(unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS INT) AS place, unnest(string_split(p_name, ' ')) AS word FROM part")
def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.posexplode(F.split("p_name", " ")).alias("place", "word")
    return read_table(spark, sf_dir, "part").select("p_partkey", words).select("p_partkey", (F.col("place") + 1).alias("place"), "word")


@query("""
SELECT c_nationkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers
FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_nationkey
""")
def partners_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both sides of a join, counted before it instead of in its pairs."""
    customers = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    suppliers = read_table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return customers.join(suppliers, F.col("c_nationkey") == F.col("s_nationkey")).select("c_nationkey", "customers", "suppliers")
