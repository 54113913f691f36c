"""Changes of a table as the table that they lead to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a column's default in a row of values.
DEFAULT = object()


def insert_values(table: DataFrame, rows: Sequence[Sequence], columns: Sequence[str] | None = None, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """table and some rows of values; columns that are not listed, and DEFAULT, get their default, or NULL."""
    names, defaults = list(columns or table.columns), dict(defaults or {})
    spark, kinds = table.sparkSession, {f.name: f.dataType for f in table.schema.fields}
    unknown = set(names) - set(kinds)
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    out = table
    for row in rows:
        if len(row) != len(names):
            raise ValueError("a row has another number of values than the list of columns")
        given = dict(zip(names, row, strict=True))
        value = lambda c: defaults.get(c, F.lit(None)) if given.get(c, DEFAULT) is DEFAULT else F.lit(given[c])  # noqa: B023, E731
        out = out.union(spark.range(1).select(*[value(c).cast(kinds[c]).alias(c) for c in table.columns]))
    return out


def insert_select(table: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """table and the rows of a query, whose columns go by position to the listed ones."""
    names, defaults = list(columns or table.columns), dict(defaults or {})
    rows = rows.toDF(*names)
    return table.union(rows.select(*[(F.col(f.name) if f.name in names else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema.fields]))


def violations(table: DataFrame, not_null: Sequence[str] = (), check: str | None = None) -> DataFrame:
    """The rows that a NOT NULL column or a CHECK rejects; a CHECK that is NULL is fulfilled."""
    bad = F.lit(False)
    for c in not_null:
        bad = bad | F.col(c).isNull()
    if check:
        bad = bad | ~F.coalesce(F.expr(check), F.lit(True))
    return table.where(bad)
