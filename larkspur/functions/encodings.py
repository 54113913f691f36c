"""Bytes of text in other character sets, and character counts of bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the character sets that Spark encodes by itself
NATIVE = frozenset("UTF-8 ISO-8859-1 US-ASCII UTF-16BE UTF-16LE UTF-16 UTF-32".split())
#: The last character of the sets that have not all.
LAST = {"ISO-8859-1": r"\xff", "US-ASCII": r"\x7f"}


def encode(text: Column, charset: str) -> Column:
    """The bytes of a text; NULL where the character set has not all of its characters."""
    if charset in LAST:  # what it has not would be an error
        return F.when(text.rlike(f"^[\\x00-{LAST[charset]}]*$"), F.encode(text, charset))
    if charset in NATIVE:
        return F.encode(text, charset)

    @F.pandas_udf(T.BinaryType())
    def by_codec(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return x.encode(charset)
            except UnicodeError:
                return None

        return values.map(one, na_action="ignore")

    return by_codec(text)


def decode(data: Column, charset: str) -> Column:
    """The text that bytes stand for; NULL where they stand for none."""

    @F.pandas_udf(T.StringType())
    def by_codec(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return x.decode(charset)
            except UnicodeError:
                return None

        return values.map(one, na_action="ignore")

    return F.decode(data, charset) if charset in NATIVE else by_codec(data)


def char_width(data: Column) -> Column:
    """Bytes of the first character of UTF-8 bytes, by its first byte; NULL for no bytes."""
    first = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    return F.when(F.octet_length(data) == 0, None).when(first < 0x80, 1).when(first < 0xE0, 2).when(first < 0xF0, 3).otherwise(4)
