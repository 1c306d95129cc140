"""Fixed patterns over the tables as graph queries: cyclic joins, optional parts, semi and anti joins, unions, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import register, table


@register(
    "pattern_cycle",
    """SELECT n_name, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey
      JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
      JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def pattern_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer - order - supplier - nation - customer: the cycle closes in the join with the suppliers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("c_nationkey"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    placed = orders.join(customer, "o_custkey").select("o_orderkey", "c_nationkey")
    hit = lines.join(placed, "o_orderkey").join(supplier, ["l_suppkey", "c_nationkey"])
    return hit.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(nation, "c_nationkey").select("n_name", "n")


@register(
    "pattern_optional",
    """SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer
      LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
)
def pattern_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey")
    folded = folded.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("p"))
    out = table(spark, sf_dir, "customer").join(folded, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce(F.round("p", 2), F.lit(0.0)).alias("total"))


@register("pattern_not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def pattern_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@register("pattern_exists", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')")
def pattern_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@register("pattern_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def pattern_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@register("pattern_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def pattern_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(5).limit(20)


@register(
    "pattern_aggregates",
    """SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high,
      round(quantile_cont(o_totalprice, 0.5), 4) AS mid FROM orders GROUP BY o_orderpriority""",
)
def pattern_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("mid"),
    )


@register(
    "pattern_unwind",
    "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id",
)
def pattern_unwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
