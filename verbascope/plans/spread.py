"""Partitions enough for all cores, before work in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` hashed by `key` over all cores if it is read in fewer partitions than there are; else unchanged, without a shuffle.

    Only inputs of a few files are shuffled, which are small; `key` should be unique or nearly so.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, key) if partitions < cores else df
