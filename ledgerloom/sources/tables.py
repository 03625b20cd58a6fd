"""Reading the warehouse's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a warehouse directory: a Parquet file or a folder of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")
