"""Corpus tables kept as Parquet, one folder or file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a corpus folder; any path that Spark can read will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
