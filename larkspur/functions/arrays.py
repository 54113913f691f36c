"""Arrays of any number of dimensions: literals, dimensions, lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse(literal: Column, element: str = "int", dimensions: int = 1) -> Column:
    """An array from a literal such as {{1,2},{3,NULL}}; NULL for what is none. Elements of text are quoted."""
    kind = "array<" * dimensions + element + ">" * dimensions
    plain = F.regexp_replace(F.translate(literal, "{}", "[]"), r"\bNULL\b", "null")
    return F.from_json(plain, kind, {"mode": "PERMISSIVE"})


def text(array: Column, dimensions: int = 1) -> Column:
    """The literal of an array of numbers."""
    inner = (lambda x: text(x, dimensions - 1)) if dimensions > 1 else (lambda x: F.coalesce(x.cast("string"), F.lit("NULL")))
    return F.concat(F.lit("{"), F.array_join(F.transform(array, inner), ","), F.lit("}"))


def dimensions(kind: T.DataType) -> int:
    """How many dimensions an array type has."""
    n = 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def length(array: Column, dimension: int = 1) -> Column:
    """The length of one dimension, counted from 1; NULL for an empty array."""
    for _ in range(dimension - 1):
        array = F.get(array, F.lit(0))
    return F.nullif(F.size(array), F.lit(0))
