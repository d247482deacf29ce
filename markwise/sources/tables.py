"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markwise.session import shipped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (a file or a directory of files)."""
    return shipped(spark).read.parquet(f"{folder}/{name}.parquet")
