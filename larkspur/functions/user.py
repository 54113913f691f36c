"""User-defined functions: scalar, aggregate and table functions, STRICT, and enumerations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def strict(function: Callable[..., Column], *args: Column) -> Column:
    """NULL if an argument is, else the function's value."""
    nothing = F.lit(False)
    for a in args:
        nothing = nothing | a.isNull()
    return F.when(~nothing, function(*args))


def enum_ordinal(value: Column, labels: Sequence[str]) -> Column:
    """The place of a label in an enumeration, from 1; NULL for what is no label."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), value), F.lit(0))


def create_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """CREATE FUNCTION with an SQL body, which the optimizer inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def create_table_function(spark: SparkSession, name: str, arguments: str, returns: str, query: str) -> None:
    """CREATE FUNCTION that returns a set of rows, by a query over its arguments."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({returns}) RETURN {query}")


def in_domain(value: Column, kind: str, check: Callable[[Column], Column], not_null: bool = False) -> Column:
    """A value of a domain: cast to its type. A value that the domain's CHECK rejects, or a NULL where it has none, is an error."""
    cast = value.cast(kind)
    bad = ~F.coalesce(check(cast), F.lit(True))
    if not_null:
        bad = bad | cast.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("no value of the domain: "), F.coalesce(value.cast("string"), F.lit("NULL")))).cast(kind)).otherwise(cast)


def aggregate(states: dict[str, Column], final: Callable[..., Column]) -> Column:
    """A user-defined aggregate: the final function of built-in aggregates, which Spark combines before the shuffle."""
    return final(*states.values())


def geometric_mean(column: str) -> Column:
    """The geometric mean of the values above 0; NULL without any."""
    x = F.col(column)
    logs = F.when(x > 0, F.ln(x))
    return aggregate({"sum": F.sum(logs), "n": F.count(logs)}, lambda s, n: F.exp(s / F.nullif(n, F.lit(0))))
