"""Queries of dates and times: the clock, formats, arithmetic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal as T
from ..tables import load
from .catalog import register
from .catalog import register_sql as q

q(
    "clock_functions",
    "SELECT current_date() AS today, date_trunc('month', current_date()) = date_trunc('month', now()) AS same_month, CAST(year(now()) AS BIGINT) AS y, current_timestamp() = now() AS one_clock, localtimestamp() > TIMESTAMP_NTZ '2024-01-01' AS later, CAST(current_timestamp() AS DATE) = current_date() AS same_day",
    "SELECT current_date AS today, date_trunc('month', current_date) = date_trunc('month', now()) AS same_month, year(now()) AS y, current_timestamp = now() AS one_clock, localtimestamp > TIMESTAMP '2024-01-01' AS later, CAST(current_timestamp AS DATE) = current_date AS same_day",
)


@register("clock_time_of_day", "SELECT regexp_matches(strftime(now(), '%H:%M:%S'), '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$') AS ok, strftime(now(), '%H') AS hour")
def clock_time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = T.current_time()
    return spark.range(1).select(now.rlike("^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$").alias("ok"), F.substring(now, 1, 2).alias("hour"))


@register(
    "date_to_char",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d.%m.%y') AS short, upper(strftime(o_orderdate, '%b')) || ' ' || strftime(o_orderdate, '%Y') AS mon, strftime(o_orderdate, '%j') AS doy, 'day ' || strftime(o_orderdate, '%A') AS day, 'Q' || quarter(o_orderdate) AS q FROM orders",
)
def date_to_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", T.to_char(d, "YYYY-MM-DD").alias("iso"), T.to_char(d, "DD.MM.YY").alias("short"), T.to_char(d, "MON YYYY").alias("mon"), T.to_char(d, "DDD").alias("doy"), T.to_char(d, '"day "Day').alias("day"), T.to_char(d, '"Q"Q').alias("q"))


@register("timestamp_to_char", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS full_time, strftime(ts, '%I:%M %p') AS clock, strftime(ts, '%f') AS micros FROM events")
def timestamp_to_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return load(spark, sf_dir, "events").select("event_id", T.to_char(t, "YYYY/MM/DD HH24:MI:SS").alias("full_time"), T.to_char(t, "HH12:MI AM").alias("clock"), T.to_char(t, "US").alias("micros"))


@register(
    "text_to_date",
    "SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS d, strptime(strftime(o_orderdate, '%Y%m%d') || ' 101530', '%Y%m%d %H%M%S') AS t, TRY_CAST('2023-02-29' AS DATE) AS none FROM orders",
)
def text_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    day, time = F.date_format(d, "dd/MM/yyyy"), F.concat(F.date_format(d, "yyyyMMdd"), F.lit(" 101530"))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.to_date(day, "DD/MM/YYYY").alias("d"), T.to_timestamp(time, "YYYYMMDD HH24MISS").alias("t"), T.to_date(F.lit("2023-02-29"), "YYYY-MM-DD").alias("none"))


@register("text_to_number", "SELECT c_custkey, CAST(c_custkey + 1000 AS BIGINT) AS whole, CAST(-(c_custkey % 1000) AS BIGINT) AS signed, CAST(NULL AS BIGINT) AS none FROM customer")
def text_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", T.to_number(F.format_number(k + 1000, 0), "9,999,999,999").cast("long").alias("whole"), T.to_number(F.concat(F.lit("-"), (k % 1000).cast("string")), "S999").cast("long").alias("signed"), T.to_number(F.lit("abc"), "999").cast("long").alias("none"))


@register(
    "date_arithmetic",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS week_later, CAST(o_orderdate AS DATE) - CAST(o_custkey % 30 AS INTEGER) AS earlier, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, o_orderdate + INTERVAL 1 MONTH AS next_month, o_orderdate + INTERVAL 3 DAY + INTERVAL 90 SECOND AS soon, o_orderdate - INTERVAL 1 YEAR AS last_year FROM orders",
)
def date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        T.add_days(d, 7).alias("week_later"),
        T.add_days(d, -(F.col("o_custkey") % 30).cast("int")).alias("earlier"),
        T.days_between(d.cast("date"), F.lit("1992-01-01").cast("date")).alias("days"),
        T.add_interval(d, months=1).alias("next_month"),
        T.add_interval(d, days=3, seconds=90).alias("soon"),
        T.add_interval(d, months=-12).alias("last_year"),
    )
