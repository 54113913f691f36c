"""Bit strings as texts of 0 and 1; both sides of an operation are of one length, else the result is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(a: Column, b: Column, bit) -> Column:
    digits = F.zip_with(F.split(a, ""), F.split(b, ""), bit)
    return F.when(F.length(a) == F.length(b), F.array_join(digits, ""))


def xor(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: F.when(x == y, "0").otherwise("1"))


def both(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))


def either(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"))


def inverted(a: Column) -> Column:
    return F.translate(a, "01", "10")
