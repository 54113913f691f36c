"""Expressions for SQL semantics that Spark has not, or has differently."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def nulls_last(name: str, descending: bool = False) -> Column:
    """Sort order with NULLs behind all values in both directions."""
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero; NULL for a zero divisor."""
    return F.when(b != 0, (a - a % b) / b).cast("long")


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def trunc_number(x: Column, digits: int = 0) -> Column:
    """A number cut towards zero at a decimal place; negative places cut left of the point."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def substr_clamped(s: Column, start: int, length: int) -> Column:
    """substring with a start before 1 moved to 1 and a negative length as 0."""
    return F.substring(s, max(start, 1), max(length, 0))


def trim_white(s: Column) -> Column:
    """Strip ASCII white space of every kind from both ends."""
    return F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def regexp_replace_first(s: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only; \\1 refers to a group. The rest of the text is captured and put back, all in the JVM."""
    rest = re.compile(pattern).groups + 1
    put = re.sub(r"\\(\d)", r"$\1", replacement)
    return F.regexp_replace(s, f"(?:{pattern})([\\s\\S]*)$", f"{put}${rest}")


def similar_to(s: Column, pattern: str) -> Column:
    """SIMILAR TO: % and _ as in LIKE, the rest as in a regular expression that matches the whole text."""
    return s.rlike("^(?:" + re.sub(r"[%_]", lambda m: ".*" if m[0] == "%" else ".", pattern) + ")$")


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    return x.between(F.least(a, b), F.greatest(a, b))


def left_part(s: Column, n: int) -> Column:
    """The first n characters; a negative n leaves out as many at the end."""
    return F.substring(s, 1, n) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right_part(s: Column, n: int) -> Column:
    """The last n characters; a negative n leaves out as many at the start."""
    return F.right(s, F.lit(n)) if n >= 0 else F.substring(s, F.lit(1 - n), F.length(s))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a time stamp without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def century(ts: Column) -> Column:
    return F.ceil(F.year(ts) / 100).cast("long")


def millennium(ts: Column) -> Column:
    return F.ceil(F.year(ts) / 1000).cast("long")


def decade(ts: Column) -> Column:
    return F.floor(F.year(ts) / 10).cast("long")


def date_trunc_wide(field: str, ts: Column) -> Column:
    """date_trunc for decade, century and millennium."""
    first = {"decade": decade(ts) * 10, "century": (century(ts) - 1) * 100 + 1, "millennium": (millennium(ts) - 1) * 1000 + 1}[field]
    return F.make_timestamp_ntz(first.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def week_simple(ts: Column) -> Column:
    """Weeks of seven days from the first of January."""
    return F.floor((F.dayofyear(ts) - 1) / 7).cast("long") + 1


def day_of_week(ts: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(ts) - 1).cast("long")


def exact_sum(x: Column, digits: int = 4) -> Column:
    """A sum of doubles that does not depend on the order of rows: added as decimals."""
    return F.sum(x.cast(f"decimal(28,{digits})")).cast("double")


def exact_avg(x: Column, digits: int = 4) -> Column:
    return F.round(F.sum(x.cast(f"decimal(28,{digits})")).cast("double") / F.count(x), 6)
