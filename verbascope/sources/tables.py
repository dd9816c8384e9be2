"""Readers of the parquet tables in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; columns are pruned and filters pushed by the plan that reads it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
