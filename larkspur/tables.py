"""Access to the input tables."""

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of sf_dir; columns and filters used later are pruned into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
