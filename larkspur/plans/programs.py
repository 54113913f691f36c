"""Queries of scripts, functions, domains, policies, changes and session settings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import user
from ..operators import dml
from ..operators.policies import Policies
from ..tables import load
from .catalog import register


@register("filter_row_security", "SELECT c_custkey, c_name FROM customer WHERE (c_nationkey < 10 OR c_mktsegment = 'BUILDING') AND c_acctbal > 100")
def filter_row_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = Policies().add("clerk", F.col("c_nationkey") < 10).add("public", F.col("c_mktsegment") == "BUILDING").add("boss", F.lit(True))
    return policies.visible(load(spark, sf_dir, "customer"), "clerk").where("c_acctbal > 100").select("c_custkey", "c_name")


@register("dml_insert_values", "SELECT r_regionkey, r_name, 0 AS size FROM region UNION ALL VALUES (10, 'a', 7), (11, NULL, 0), (12, 'none', 0), (13, 'none', NULL)")
def dml_insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of values with a list of columns, defaults and NULLs."""
    table = load(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit(0).alias("size"))
    defaults = {"r_name": F.lit("none"), "size": F.lit(0)}
    table = dml.insert_values(table, [(10, "a", 7), (11, None, dml.DEFAULT)], defaults=defaults)
    table = dml.insert_values(table, [(12,)], ["r_regionkey"], defaults)
    return dml.insert_values(table, [(None, 13)], ["size", "r_regionkey"], defaults)


@register("dml_insert_columns", "SELECT r_regionkey, r_name, 0 AS size FROM region UNION ALL SELECT n_nationkey + 100, n_name, 5 FROM nation")
def dml_insert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit(0).alias("size"))
    return dml.insert_select(table, load(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey") + 100), ["r_name", "r_regionkey"], {"size": F.lit(5)})


@register("dml_constraints", "SELECT p_partkey, p_size FROM part WHERE p_size > 40 OR CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END IS NULL")
def dml_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a NOT NULL column or a CHECK keeps out; files.check_rows makes them an error."""
    part = load(spark, sf_dir, "part").withColumn("p_name", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")))
    return dml.violations(part, ("p_name",), "p_size <= 40").select("p_partkey", "p_size")


@register("domain_values", "SELECT p_partkey, CAST(p_size AS SMALLINT) AS size, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part")
def domain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two domains, whose checks all rows fulfil; the tests have rows that don't."""
    return load(spark, sf_dir, "part").select("p_partkey", user.in_domain(F.col("p_size"), "smallint", lambda v: v.between(1, 50), not_null=True).alias("size"), user.in_domain(F.col("p_retailprice"), "decimal(12,2)", lambda v: v >= 0).alias("price"))


@register("table_function", "SELECT n_nationkey, CAST(unnest(range(1, n_regionkey + 1)) AS INTEGER) AS n FROM nation")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that returns rows, called for each row of a table."""
    user.create_table_function(spark, "numbers_to", "last INT", "n INT", "SELECT explode(filter(sequence(1, 100), x -> x <= last))")
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, f.n FROM nation, LATERAL numbers_to(n_regionkey) f")


@register(
    "procedural_script",
    """SELECT CAST(sum(CASE n_regionkey WHEN 1 THEN 0 WHEN 2 THEN 10 * n_nationkey ELSE n_nationkey END) FILTER (n_nationkey < 20) AS INTEGER) AS total,
              CAST(count(*) FILTER (n_nationkey < 20 AND n_regionkey <> 1) AS INTEGER) AS seen, 'stopped' AS state, CAST(2048 AS INTEGER) AS power FROM nation""",
)
def procedural_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with FOR over a query, ELSEIF, ITERATE (continue), LEAVE (exit and return), WHILE, LOOP and REPEAT."""
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql(
        """BEGIN
             DECLARE total INT DEFAULT 0;
             DECLARE seen INT DEFAULT 0;
             DECLARE power INT DEFAULT 1;
             DECLARE state STRING DEFAULT 'ended';
             body: BEGIN
               rows: FOR r AS SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_nationkey DO
                 IF r.n_nationkey >= 20 THEN SET state = 'stopped'; LEAVE rows;
                 ELSEIF r.n_regionkey = 1 THEN ITERATE rows;
                 ELSEIF r.n_regionkey = 2 THEN SET total = total + 10 * r.n_nationkey;
                 ELSE SET total = total + r.n_nationkey;
                 END IF;
                 SET seen = seen + 1;
               END FOR rows;
               WHILE power < 256 DO SET power = power * 2; END WHILE;
               again: LOOP
                 SET power = power * 2;
                 IF power > 1000 THEN LEAVE again; END IF;
               END LOOP again;
               REPEAT SET power = power * 2; UNTIL power > 2000 END REPEAT;
               IF total > 0 THEN LEAVE body; END IF;
               SET total = -1;
             END body;
             SELECT total, seen, state, power;
           END"""
    )


@register("session_settings")
def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's user, catalog, schema and time zone, whose values are the session's own."""
    return spark.sql("SELECT current_user() AS user_name, session_user() AS session_name, current_catalog() AS catalog_name, current_schema() AS schema_name, current_timezone() AS zone")
