"""Queries of column statistics and sketches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stats import profile as P
from ..tables import load
from .catalog import register


def _profile_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, round(1 - count({c}) / CAST(count(*) AS DOUBLE), 6) AS null_fraction, round(avg(length(CAST({c} AS VARCHAR))), 6) AS avg_width, count(DISTINCT {c}) AS n_distinct FROM {table}" for c in columns)


@register("stats_profile", _profile_sql("customer", ["c_name", "c_nationkey", "c_mktsegment"]))
def stats_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_profile(load(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@register("stats_common_values", "SELECT l_suppkey AS value, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 9) AS frequency FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def stats_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.common_values(load(spark, sf_dir, "lineitem"), "l_suppkey").withColumn("frequency", F.round("frequency", 9))


@register("stats_histogram", "SELECT generate_subscripts(b, 1) - 1 AS bound, unnest(b) AS value FROM (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS b FROM orders)")
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(load(spark, sf_dir, "orders"), "o_custkey")


@register("stats_estimate_distinct", "WITH c AS (SELECT o_custkey, count(*) AS c FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1), s AS (SELECT count(*) AS d, CAST(sum(CAST(c = 1 AS INTEGER)) AS BIGINT) AS f1, CAST(sum(c) AS BIGINT) AS n FROM c) SELECT d, f1, n, round((d + CASE WHEN f1 > 0 AND n > f1 THEN f1 * n / CAST(n - f1 AS DOUBLE) ELSE 0 END) * (SELECT count(*) FROM orders) / n, 6) AS estimate FROM s")
def stats_estimate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a tenth of orders, the sampling that the estimator is tested on; the table's size is counted over all of orders."""
    orders = load(spark, sf_dir, "orders")
    sample = orders.where("o_orderkey % 10 = 0")
    return P.estimate_distinct(sample, "o_custkey", orders.agg(F.count("*")).scalar()).withColumn("estimate", F.round("estimate", 6))


@register("stats_joint_distinct", "SELECT 'o_orderstatus+o_orderpriority' AS columns, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n FROM orders UNION ALL SELECT 'o_orderstatus+o_custkey', count(DISTINCT (o_orderstatus, o_custkey)) FROM orders UNION ALL SELECT 'o_orderpriority+o_custkey', count(DISTINCT (o_orderpriority, o_custkey)) FROM orders UNION ALL SELECT 'o_orderstatus+o_orderpriority+o_custkey', count(DISTINCT (o_orderstatus, o_orderpriority, o_custkey)) FROM orders")
def stats_joint_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.joint_distinct(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def _dependency_sql(table: str, columns: list[str]) -> str:
    pairs = [(a, b) for a in columns for b in columns if a != b]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(1 - CAST(sum(k - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS degree FROM (SELECT {a}, count(DISTINCT {b}) AS k, count(*) AS n FROM {table} GROUP BY 1)" for a, b in pairs)


@register("stats_dependency", _dependency_sql("orders", ["o_custkey", "o_orderpriority", "o_orderstatus"]))
def stats_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dependencies(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"]).withColumn("degree", F.round("degree", 9))


@register("stats_approx_distinct", "SELECT abs(approx_count_distinct(l_orderkey) / CAST(count(DISTINCT l_orderkey) AS DOUBLE) - 1) < 0.1 AS within, count(DISTINCT l_orderkey) AS exact FROM lineitem")
def stats_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's count lies within three hundredths of the exact one."""
    one = P.distinct_counts(load(spark, sf_dir, "lineitem"), "l_orderkey")
    return one.select(F.coalesce(F.abs(F.try_divide("approximate", "exact") - 1) < 0.03, F.lit(False)).alias("within"), "exact")


@register("stats_merged_sketches", "SELECT 'all' AS part, count(DISTINCT l_linenumber) AS n FROM lineitem UNION ALL SELECT l_returnflag, count(DISTINCT l_linenumber) FROM lineitem GROUP BY 1")
def stats_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by flag, their estimates, and the estimate of their union; few values are counted exactly by a sketch."""
    parts = P.sketches(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber")
    whole = P.merged_sketches(parts, [])
    return P.estimates(parts).select(F.col("l_returnflag").alias("part"), "n").union(P.estimates(whole).select(F.lit("all"), "n"))


@register("bloom_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Bloom filter over the keys thins the scan; what passes it is confirmed by a semi join."""
    keys = load(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    likely = P.might_contain(load(spark, sf_dir, "orders"), "o_custkey", P.bloom_filter(keys, "o_custkey"))
    return likely.join(keys, "o_custkey", "left_semi").select("o_orderkey")
