"""Places in sorted groups of any size, without one task a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import materialise


def with_place(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """`df` with each row's place, from 1, in `order` within its group; null is a group, rows of equal order follow each other.

    Rows are split into ranges of group and order, placed within their range, and moved on by what earlier
    ranges hold of the group: a group that fills many ranges is many tasks' work. Names that begin with
    `_range` are taken.
    """
    ranged = materialise(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    held = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_range_rows"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = held.select(*(F.col(c).alias(f"_range_{c}") for c in by), F.col("_range").alias("_range_number"), F.coalesce(F.sum("_range_rows").over(before), F.lit(0)).alias("_range_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_range_{c}")) for c in by]
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    placed = ranged.withColumn("_range_place", within).join(offsets, [F.col("_range") == F.col("_range_number"), *same])
    return placed.select(*df.columns, (F.col("_range_place") + F.col("_range_before")).cast("bigint").alias(name))


def shard_of(place: Column, size: int) -> Column:
    """The number of the shard of `size` rows that a place from 1 falls in."""
    return F.floor((place - 1) / size)
