"""Parquet tables addressed by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet`` (a file or a folder of files, on any store Spark reads)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
