"""Queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import exact, exact_sum, squared_length
from tessera.operators.temporal import top_k
from tessera.plans.registry import query
from tessera.sources.files import read_table


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return (
        lines.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(exact_sum("l_quantity").alias("sum_qty"), exact_sum("l_extendedprice").alias("sum_base_price"), F.count("*").alias("count_order"))
    )


@query("""
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey AND c_nationkey = n_nationkey
GROUP BY n_name
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read_table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    joined = joined.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum(exact("l_extendedprice") * exact(1 - F.col("l_discount"))).cast("double").alias("revenue"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY o_orderpriority")
def priorities_of_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


@query("SELECT orders, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY orders")
def orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return each.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders")).groupBy("orders").agg(F.count("*").alias("customers"))


@query("""
SELECT coalesce(c.n, s.n) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers
FROM (SELECT c_nationkey AS n, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.n = s.n
""")
def rich_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = read_table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = read_table(spark, sf_dir, "nation").alias("a"), read_table(spark, sf_dir, "nation").alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return pairs.select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


@query("""
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS all_status, grouping(o_orderpriority) AS all_priority, count(*) AS orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = read_table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    of = lambda c: F.grouping(c).cast("long")
    return cube.agg(of("o_orderstatus").alias("all_status"), of("o_orderpriority").alias("all_priority"), F.count("*").alias("orders"), exact_sum("o_totalprice").alias("total"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS customers FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("customers"))


@query("SELECT p_brand, p_size, count(*) AS parts FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part")
    return parts.groupingSets([[F.col("p_brand")], [F.col("p_size")], []], F.col("p_brand"), F.col("p_size")).agg(F.count("*").alias("parts"))


@query("""
SELECT year(o_orderdate) AS year, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY 1
""")
def status_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    return orders.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""
SELECT c_custkey, o_orderkey, rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3
""")
def best_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = top_k(read_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)
    return ranked.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS running, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS level, ntile(4) OVER w AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.sum(exact("o_totalprice")).over(w).cast("double").alias("running"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"),
        F.dense_rank().over(W.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("long").alias("level"), F.ntile(4).over(w).cast("long").alias("quarter"),
    )


@query("""
SELECT key, count(*) AS n FROM (
  (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) EXCEPT ALL (SELECT n_nationkey FROM nation)
) GROUP BY key
""")
def partners_beyond_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda name, c: read_table(spark, sf_dir, name).select(F.col(c).alias("key"))
    left = keys("customer", "c_nationkey").unionAll(keys("supplier", "s_nationkey")).exceptAll(keys("nation", "n_nationkey"))
    return left.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def active_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    builders = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).intersect(builders)


@query("""
SELECT l_returnflag, median(l_quantity) AS middle, quantile_cont(l_quantity, 0.9) AS high, count(DISTINCT l_partkey) AS parts,
       max_by(l_orderkey, (l_extendedprice, l_orderkey)) AS dearest FROM lineitem GROUP BY l_returnflag
""")
def quantity_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return grouped.agg(
        F.median("l_quantity").alias("middle"), F.percentile("l_quantity", 0.9).alias("high"), F.countDistinct("l_partkey").alias("parts"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("dearest")
    )


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def nations_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read_table(spark, sf_dir, "region").join(read_table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@query("SELECT p_partkey, upper(p_name) AS name, split_part(p_type, ' ', 1) AS kind, regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand, length(p_name) AS length FROM part WHERE p_size BETWEEN 10 AND 20")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").where("p_size BETWEEN 10 AND 20")
    return parts.select("p_partkey", F.upper("p_name").alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), F.regexp_replace("p_brand", "[^0-9]", "").alias("brand"), F.length("p_name").cast("long").alias("length"))


@query("""
SELECT label, count(*) AS vectors, max(list_max(embedding)) AS highest, min(list_min(embedding)) AS lowest, max(len(embedding)) AS size
FROM embeddings GROUP BY label
""")
def vector_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read_table(spark, sf_dir, "embeddings").groupBy("label")
    return grouped.agg(F.count("*").alias("vectors"), F.max(F.array_max("embedding")).alias("highest"), F.min(F.array_min("embedding")).alias("lowest"), F.max(F.size("embedding")).cast("long").alias("size"))


@query("SELECT vec_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), lambda s, x: s + x) AS squared FROM embeddings")
def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", squared_length(F.col("embedding")).alias("squared"))


@query("""
SELECT CAST(m AS TIMESTAMP) AS month, count(o_orderkey) AS orders
FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH) AS s(m) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m AND o_orderpriority = '1-URGENT'
GROUP BY m
""")
def urgent_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without orders count too, so the calendar leads the join."""
    months = spark.sql("""
        WITH RECURSIVE calendar(month) AS (SELECT TIMESTAMP_NTZ '1995-01-01' UNION ALL SELECT CAST(add_months(month, 1) AS TIMESTAMP_NTZ) FROM calendar WHERE month < TIMESTAMP_NTZ '1996-12-01')
        SELECT month FROM calendar
    """)
    orders = read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"))
    return months.join(orders, "month", "left").groupBy("month").agg(F.count("o_orderkey").alias("orders"))


@query("""
SELECT r_name, n_name, customers FROM (
  SELECT r_name, n_name, count(*) AS customers, row_number() OVER (PARTITION BY r_name ORDER BY count(*) DESC, n_name) AS k
  FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name) WHERE k <= 2
""")
def region_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read_table(spark, sf_dir, "nation").alias("n")
    sizes = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    counted = nations.join(sizes, F.col("n_nationkey") == F.col("c_nationkey")).join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return top_k(counted, ["r_name"], [F.desc("customers"), "n_name"], 2).select("r_name", "n_name", "customers")


@query("""
SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 49) AS large,
       (SELECT max(l_extendedprice) FROM lineitem WHERE l_suppkey = s_suppkey) AS dearest FROM supplier WHERE s_acctbal < 0
""")
def suppliers_in_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two correlated subqueries as one conditional aggregate."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") >= 49).alias("large"), F.max("l_extendedprice").alias("dearest"))
    owing = read_table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    return owing.join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("large", F.lit(0)).alias("large"), "dearest")
