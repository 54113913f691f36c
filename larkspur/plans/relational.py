"""Relational queries by the DataFrame API."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import user
from ..operators import ordered as O
from ..operators import relational as R
from ..sources import files
from ..streaming import windows
from ..tables import load
from .catalog import register


@register(
    "flagship_pricing_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
              round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_price
       FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2 HAVING count(*) > 10""",
)
def flagship_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") < F.expr("timestamp_ntz'2001-01-01'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*"), 4).alias("avg_price"),
        )
        .where("n > 10")
        .orderBy(F.col("l_returnflag").asc_nulls_last(), F.col("l_linestatus").asc_nulls_last())
    )


@register("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_on(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("limit_with_ties", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def limit_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limit_with_ties(load(spark, sf_dir, "part"), 10, [F.desc_nulls_last("p_size")], ["p_size"]).select("p_partkey", "p_size")


@register("window_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def window_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.groups_frame(load(spark, sf_dir, "part"), ["p_brand"], "p_size", 2, 1, n=lambda: F.count("*")).select("p_partkey", "n")


@register("project_set", "SELECT n_nationkey, unnest(range(1, CAST(n_regionkey + 1 AS BIGINT))) AS a, unnest([10, 20]) AS b FROM nation")
def project_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.when(F.col("n_regionkey") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_regionkey").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return R.project_set(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), a=series, b=F.array(F.lit(10), F.lit(20))).drop("n_regionkey")


@register("cte_recursive_distinct", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), t(n) AS (SELECT CAST(1 AS INTEGER) UNION SELECT CAST(b AS INTEGER) FROM t JOIN e ON n = a) SELECT n FROM t")
def cte_recursive_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    seed = spark.range(1).select(F.lit(1).alias("n"))
    return R.recursive_distinct(seed, lambda new: new.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")))


@register("not_in_with_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey = 5 THEN NULL ELSE s_nationkey END FROM supplier)")
def not_in_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = load(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") != 5, F.col("s_nationkey")).alias("k"))
    return R.not_in(load(spark, sf_dir, "nation"), "n_nationkey", other, "k").select("n_nationkey")


@register("not_in_without_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 12)")
def not_in_without_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.not_in(load(spark, sf_dir, "nation"), "n_nationkey", load(spark, sf_dir, "supplier").where("s_suppkey < 12"), "s_nationkey").select("n_nationkey")


@register("crosstab_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def crosstab_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.pivot(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))
    return out.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in "FOP"])


@register("query_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def query_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_orderstatus = :s AND o_totalprice > :p", args={"s": "P", "p": 200000}, orders=load(spark, sf_dir, "orders"))


@register("dml_insert_select", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, upper(r_name) FROM region WHERE r_regionkey > 2")
def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return region.unionByName(region.where("r_regionkey > 2").select((F.col("r_regionkey") + 100).alias("r_regionkey"), F.upper("r_name").alias("r_name")))


@register("dml_update", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_size") > 40, 0).otherwise(F.col("p_size"))).select("p_partkey", "p_size")


@register("dml_delete", "SELECT p_partkey FROM part WHERE (p_size > 40) IS NOT TRUE")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(~F.coalesce(F.col("p_size") > 40, F.lit(False))).select("p_partkey")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("copy_round_trip", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal FROM customer")
def copy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("c_name"), "c_acctbal")
    return files.copy_from(spark, files.copy_to(out, _folder(spark, "copy")), out.schema)


@register("foreign_csv_scan", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 9")
def foreign_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return files.read_foreign_csv(spark, files.copy_to(out, _folder(spark, "csv"), ","), out.schema).where("n_nationkey < 9")


@register("partition_pruning", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.write_partitioned(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), _folder(spark, "parts"), "o_orderstatus")
    return spark.read.parquet(path).where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


@register("view_expansion", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_nationkey = 7")
def view_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "customer").where("c_acctbal > 5000").createOrReplaceTempView("rich_customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM rich_customer WHERE c_nationkey = 7")


@register("udf_sql_function", "SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def udf_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    user.create_function(spark, "twice_plus_one", "x INT", "INT", "x * 2 + 1")
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, twice_plus_one(p_size) AS y FROM part")


@register("udf_strict", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey + 1 END AS y FROM customer")
def udf_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey"))
    return load(spark, sf_dir, "customer").select("c_custkey", user.strict(lambda v: F.coalesce(v, F.lit(0)) + 1, x).alias("y"))


@register("udaf_geometric_mean", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS g FROM part WHERE p_retailprice > 0 GROUP BY p_brand")
def udaf_geometric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(user.geometric_mean("p_retailprice").alias("g")).withColumn("g", F.round("g", 4))


@register("enum_ordinal", "SELECT o_orderkey, CAST(list_position(['O', 'F'], o_orderstatus) AS BIGINT) AS k FROM orders")
def enum_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", user.enum_ordinal(F.col("o_orderstatus"), ["O", "F"]).alias("k"))


@register("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed aggregate of the streaming module, over the table."""
    return windows.hourly_counts(load(spark, sf_dir, "events"))


@register("explain_formatted")
def explain_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("EXPLAIN FORMATTED SELECT o_custkey, count(*) FROM orders WHERE o_totalprice > 10 GROUP BY o_custkey")


@register("collate_case_insensitive", "SELECT lower(n_name) AS k, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT lower(n_name) FROM nation) GROUP BY 1")
def collate_case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "nation").select("n_name")
    both = names.union(names.select(F.lower("n_name")))
    return both.groupBy(F.collate("n_name", "UTF8_LCASE").alias("c")).agg(F.count("*").alias("n")).select(F.lower(F.collate("c", "UTF8_BINARY")).alias("k"), "n")


@register("sample_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey * 7919 % 1000 < 100")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable tenth of the rows, dealt by a multiple of the key; sampling is the feature."""
    return R.sample_by_key(load(spark, sf_dir, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@register("copy_binary", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal, encode(c_mktsegment) AS b FROM customer WHERE c_acctbal > 0")
def copy_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY (query) TO in binary form and FROM it: types, NULLs and bytes come back as they were."""
    out = load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("c_name"), "c_acctbal", F.encode("c_mktsegment", "UTF-8").alias("b"))
    return files.copy_from(spark, files.copy_to(out, _folder(spark, "copy"), binary=True), out.schema, binary=True)


@register("subquery_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def subquery_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN as an anti join by key and a count of NULLs, where Spark's own plan would broadcast the orders."""
    return R.not_in(load(spark, sf_dir, "customer"), "c_custkey", load(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey").select("c_custkey")


@register("limit_offset_only", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders OFFSET 40)")
def limit_offset_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.offset_rows(load(spark, sf_dir, "orders").select("o_orderkey"), 40).agg(F.count("*").alias("n"))


@register("fetch_first_rows", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12 OFFSET 3")
def fetch_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fetch_first(load(spark, sf_dir, "part"), 12, [F.desc_nulls_last("p_retailprice"), F.asc("p_partkey")], offset=3).select("p_partkey", "p_retailprice")


@register("merge_append", "SELECT k, src FROM (SELECT n_nationkey AS k, 'n' AS src FROM nation UNION ALL SELECT s_suppkey, 's' FROM supplier) ORDER BY k, src")
def merge_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit("n").alias("src"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("src"))
    return O.merge_sorted([a, b], [F.asc_nulls_last("k"), F.asc("src")])


@register("cte_materialized", "WITH t AS MATERIALIZED (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), u AS NOT MATERIALIZED (SELECT k FROM t WHERE n > 5) SELECT t.k, t.n, (SELECT max(n) FROM t) AS most FROM t JOIN u USING (k)")
def cte_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table expression that is computed once for all of its uses; others are planned where they stand."""
    t = R.materialized(load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")))
    most = t.agg(F.max("n").alias("most"))
    return t.join(t.where("n > 5").select("k"), "k").join(F.broadcast(most)).select("k", "n", "most")  # one row


@register("agg_group_by_distinct", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def agg_group_by_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GROUP BY DISTINCT ROLLUP (status, priority), ROLLUP (priority): each set of keys once."""
    sets = R.crossed_sets(R.rollup_sets("o_orderstatus", "o_orderpriority"), R.rollup_sets("o_orderpriority"))
    return R.group_by_sets(load(spark, sf_dir, "orders"), sets, F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "n")


@register("agg_mode", "SELECT p_size AS mode FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1")
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mode(load(spark, sf_dir, "part"), [], "p_size")


@register("agg_percentile_disc", "SELECT l_returnflag, quantile_disc(l_quantity, 0.25) AS q1, quantile_disc(l_quantity, 0.9) AS q9 FROM lineitem GROUP BY l_returnflag")
def agg_percentile_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.percentiles(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"q1": (0.25, False), "q9": (0.9, False)})


@register("agg_percentile_array", "SELECT l_returnflag, quantile_disc(l_linenumber, [0.1, 0.5, 1.0]) AS qs FROM lineitem GROUP BY l_returnflag")
def agg_percentile_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discrete percentile for each of several shares, as an array."""
    shares = (0.1, 0.5, 1.0)
    out = O.percentiles(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", {str(k): (s, False) for k, s in enumerate(shares)})
    return out.select("l_returnflag", F.array(*[F.col(str(k)) for k in range(len(shares))]).alias("qs"))


@register("agg_percentile_cont", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med FROM lineitem GROUP BY l_returnflag")
def agg_percentile_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.percentiles(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"med": (0.5, True)}).withColumn("med", F.round("med", 4))


@register("window_rank_few_keys", "SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)")
def window_rank_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within three keys, from counts; no task sorts the rows of a key."""
    return O.ranks(load(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderdate", "rk", "dr").select("o_orderkey", "rk", "dr")


@register("window_running_few_keys", "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS s, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def window_running_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums within five keys, by ranges of the order."""
    out = O.running_total(load(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], s=F.col("o_custkey"), n=F.lit(1))
    return out.select("o_orderkey", "s", F.col("n").cast("long").alias("n"))


@register("window_sliding_few_keys", "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS s, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def window_sliding_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding frames within three keys, by runs of rows that overlap by the frame."""
    out = O.sliding_rows(load(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey"], 2, 1, s=F.sum("o_custkey"), hi=F.max("o_totalprice"))
    return out.select("o_orderkey", "s", "hi")


@register("join_comma_residual", "SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_nationkey = c_nationkey AND s_acctbal < c_acctbal")
def join_comma_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly every pair of a nation is a row, so the pairs are spread, not the nations."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return R.block_join(c, s, "c_nationkey", "s_nationkey", F.col("s_acctbal") < F.col("c_acctbal")).select("s_suppkey", "c_custkey")
