"""Ranges as structs of bounds, their inclusion, and emptiness; a null bound is unbounded."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, lower_inc: bool = True, upper_inc: bool = False) -> Column:
    """A range; it is empty if no value can lie in it."""
    nothing = F.coalesce((lower > upper) | (lower == upper) & F.lit(not (lower_inc and upper_inc)), F.lit(False))
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(lower_inc).alias("lower_inc"), F.lit(upper_inc).alias("upper_inc"), nothing.alias("empty"))


def parse(text: str, kind: str = "int") -> Column:
    """A range literal: [a,b), (a,b], with bounds left out where unbounded, or empty."""
    if text.strip() == "empty":
        none = F.lit(None).cast(kind)
        return F.struct(none.alias("lower"), none.alias("upper"), F.lit(False).alias("lower_inc"), F.lit(False).alias("upper_inc"), F.lit(True).alias("empty"))
    m = re.fullmatch(r"\s*([\[(])\s*([^,]*?)\s*,\s*([^,]*?)\s*([\])])\s*", text)
    if not m:
        raise ValueError(f"no range: {text}")
    bound = lambda s: F.lit(s or None).cast(kind)
    return make(bound(m[2]), bound(m[3]), m[1] == "[", m[4] == "]")


def contains(r: Column, x: Column) -> Column:
    low = r["lower"].isNull() | (x > r["lower"]) | r["lower_inc"] & (x == r["lower"])
    high = r["upper"].isNull() | (x < r["upper"]) | r["upper_inc"] & (x == r["upper"])
    return ~r["empty"] & low & high


def text(r: Column) -> Column:
    """The literal of a range."""
    bound = lambda c: F.coalesce(r[c].cast("string"), F.lit(""))
    body = F.concat(F.when(r["lower_inc"] & r["lower"].isNotNull(), "[").otherwise("("), bound("lower"), F.lit(","), bound("upper"), F.when(r["upper_inc"] & r["upper"].isNotNull(), "]").otherwise(")"))
    return F.when(r["empty"], "empty").otherwise(body)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: empty ranges first, then by lower bound, unbounded first, then by upper bound, unbounded last."""

    def by(x: Column, y: Column, x_inc: Column, y_inc: Column, missing: int, closed: int) -> Column:
        none = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), missing).when(y.isNull(), -missing)
        return none.when(x < y, -1).when(x > y, 1).when(x_inc == y_inc, 0).when(x_inc, closed).otherwise(-closed)

    lower = by(a["lower"], b["lower"], a["lower_inc"], b["lower_inc"], -1, -1)
    upper = by(a["upper"], b["upper"], a["upper_inc"], b["upper_inc"], 1, 1)
    return F.when(a["empty"] & b["empty"], 0).when(a["empty"], -1).when(b["empty"], 1).when(lower != 0, lower).otherwise(upper)
