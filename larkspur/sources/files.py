"""Delimited files in and out."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the session's checkpoints use from here on.

    Where it is unset, a local session gets a temporary folder. On a cluster the executors don't see such a folder, so there
    it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return found or held.get()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("name a folder that all executors see in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="larkspur-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def read_foreign_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A foreign table over a CSV file: declared schema, no quoting, an empty field is NULL."""
    return spark.read.csv(path, schema=schema, sep=",", quote="", nullValue="", emptyValue="")


def copy_from(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = "\t", binary: bool = False) -> DataFrame:
    """COPY FROM: delimited text with the declared schema, an empty field is NULL; or the binary form of copy_to."""
    if binary:
        return spark.read.schema(schema).parquet(path)
    return spark.read.csv(path, schema=schema, sep=delimiter, quote="", nullValue="", emptyValue="")


def copy_to(df: DataFrame, path: str, delimiter: str = "\t", binary: bool = False) -> str:
    """COPY (query) TO: delimited text, NULL as an empty field; binary: typed columns, as Parquet. Each task writes its own file."""
    if binary:
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path, sep=delimiter, quote="", nullValue="", emptyValue="")
    return path


def write_partitioned(df: DataFrame, path: str, *keys: str) -> str:
    """A table in folders by key, so that filters on the keys prune files.

    The rebalance brings the rows of a key together and splits large keys over several tasks.
    """
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return path


def check_rows(df: DataFrame, not_null: tuple[str, ...] = (), check: str | None = None) -> DataFrame:
    """Rows for a table with NOT NULL columns and a CHECK: a violation fails the write."""
    from pyspark.sql import functions as F

    bad = F.lit(False)
    for c in not_null:
        bad = bad | F.col(c).isNull()
    if check:
        bad = bad | ~F.coalesce(F.expr(check), F.lit(True))
    return df.where(F.when(bad, F.raise_error("a row violates a constraint of the table").cast("boolean")).otherwise(True))
