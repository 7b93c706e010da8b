"""The provided tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns are pruned by whatever reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
