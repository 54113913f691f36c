"""Every query of the relational catalogue against its SQL in DuckDB, at the smallest scale."""

import datetime
import decimal
import os

import duckdb
import pytest

from larkspur.plans import catalog

SF = os.environ.get("LARKSPUR_SF", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"d{v}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.date):
        return str(v)
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([norm(r[c]) for c in columns] for r in df.collect())
    if name not in catalog.oracle_sql():
        assert rows
        return
    found = duck.sql(catalog.oracle_sql()[name])
    names = found.columns
    assert sorted(names) == columns
    assert rows == sorted([norm(dict(zip(names, r, strict=True))[c]) for c in columns] for r in found.fetchall())
