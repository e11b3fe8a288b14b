"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables: a Parquet file, or a folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
