"""Event-time windows over an unbounded table of events: an extension, for feeds of deliveries or judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, folder: str, like: DataFrame, files_a_trigger: int = 8) -> DataFrame:
    """The parquet files that appear in `folder`, as a stream with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, *by, n): events by window of event time; those later than `late` are dropped by the watermark. Works on tables too."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).where("_at is not null")
    timed = timed.withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def write_once(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there and stops; finished windows are appended to `path` exactly once."""
    query = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
