"""Dates and times: formats by template, arithmetic, and the clock."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the template fields of to_char and what Spark calls them
FIELDS = {"YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "Month": "MMMM", "MON": "MMM", "Mon": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "Day": "EEEE", "DY": "EEE", "Dy": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "q"}
UPPER = {"MONTH", "MON", "DAY", "DY"}
_FIELD = re.compile("|".join(sorted(FIELDS, key=len, reverse=True)) + r'|"[^"]*"|[A-Za-z]+|.', re.S)


def pattern(template: str) -> str:
    """A template as Spark's pattern; letters that are no field, and text in double quotes, stand for themselves."""
    out = []
    for part in _FIELD.findall(template):
        if part in FIELDS:
            out.append(FIELDS[part])
        elif part[0] == '"' or part.isalpha() or part == "'":
            out.append("'" + part.strip('"').replace("'", "''") + "'")
        else:
            out.append(part)
    return "".join(out)


def to_char(value: Column, template: str) -> Column:
    """A date or time stamp as text by a template; fields in capitals such as MON give capitals."""
    parts, held = [], ""
    for part in _FIELD.findall(template):
        if part in UPPER:
            if held:
                parts.append(F.date_format(value, pattern(held)))
            parts.append(F.upper(F.date_format(value, FIELDS[part])))
            held = ""
        else:
            held += part
    if held or not parts:
        parts.append(F.date_format(value, pattern(held)) if held else F.lit(""))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def to_date(text: Column, template: str) -> Column:
    """The date that a text holds; NULL for what is none."""
    return F.try_to_date(text, pattern(template))


def to_timestamp(text: Column, template: str) -> Column:
    """The time stamp without zone that a text holds; NULL for what is none."""
    return F.try_to_timestamp(text, F.lit(pattern(template))).cast("timestamp_ntz")


def to_number(text: Column, template: str) -> Column:
    """The number that a text of digits, signs and separators holds, by a template of 9, 0, comma, point, S, MI and dollar sign.

    NULL for a text that does not fit.
    """
    return F.try_to_number(text, F.lit(template))


def add_days(value: Column, days: Column | int) -> Column:
    """A date and a number of days."""
    return F.date_add(value.cast("date"), days)


def days_between(later: Column, earlier: Column) -> Column:
    """Days from one date to another."""
    return F.datediff(later, earlier)


def add_interval(value: Column, months: int = 0, days: int = 0, seconds: float = 0) -> Column:
    """A time stamp and an interval; months that lead past a month's end lead to its last day."""
    out = value + F.make_ym_interval(F.lit(0), F.lit(months)) if months else value
    return out + F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(float(seconds))) if days or seconds else out


def current_time() -> Column:
    """The session's time of day as text, to the second."""
    return F.date_format(F.current_timestamp(), "HH:mm:ss")
