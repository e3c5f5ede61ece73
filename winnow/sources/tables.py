"""The named tables of a data folder, read lazily by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder`` may be in any store that Spark reads; the scan prunes columns and takes pushed filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
