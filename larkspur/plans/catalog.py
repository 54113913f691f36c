"""The registry of queries: each module registers queries with their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import load

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a DataFrame query under a name; sql is its DuckDB equivalent, None where SQL can't express it."""

    def add(query: Query) -> Query:
        _queries[name] = query
        if sql:
            _sql[name] = sql
        return query

    return add


def register_sql(name: str, spark_text: str, duck_text: str | None = None) -> None:
    """Add a query in Spark SQL; duck_text is given where the dialects differ."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", spark_text)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            load(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_text)

    _queries[name] = query
    _sql[name] = duck_text or spark_text


def _load() -> None:
    from . import analytics, functions, programs, relational, search, sql, statistics, temporal, types  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql
