"""References to records that are not there, at the time they were made.

A parent record is there at a time if the latest of its deliveries and removals up to that time is a
delivery. The operator co-partitions references with the parents' events by (table, language, key, hour),
sorts each partition by time and merges both streams in one forward pass; a parent's state at the start of an
hour is carried over from the hours before, of which only one row per key and hour is kept. A key that holds a
third of all rows is therefore spread over its hours, and its hours are summed up before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clean_key

PARENT = ["target", "lang", "key"]
#: Classes of a reference.
FOUND, MISSING, DELETED, LATE, EMPTY, UNDATED = "found", "missing", "deleted", "late", "empty", "undated"


def parent_events(df: DataFrame, target: str, key: str, at: str, present: bool) -> DataFrame:
    """Deliveries (`present`) or removals of one parent table. Rows without language, key or time name no event."""
    return df.select(
        F.lit(target).alias("target"),
        F.col("lang"),
        clean_key(F.col(key)).alias("key"),
        F.col(at).cast("timestamp").alias("at"),
        F.lit(1 if present else 0).alias("present"),
    ).where("lang is not null and key is not null and at is not null")


def references(df: DataFrame, tab: str, row_id: str, target: str, key: str, at: str) -> DataFrame:
    """The references that one table makes to `target`."""
    return df.select(
        F.lit(tab).alias("tab"),
        F.col(row_id).alias("row_id"),
        F.lit(target).alias("target"),
        F.col("lang"),
        clean_key(F.col(key)).alias("key"),
        F.col(at).cast("timestamp").alias("at"),
    )


def resolve_references(refs: DataFrame, events: DataFrame) -> DataFrame:
    """Each row of `refs` once, with `status`.

    refs: (tab, row_id, target, lang, key, at); events: (target, lang, key, at, present). Status: `found`;
    `missing`, never delivered; `late`, first delivered after the reference; `deleted`, removed at that time;
    `empty`, the key or language is null or blank, so that nothing is referred to; `undated`, no time is given.
    A delivery and a removal at the same instant count as a delivery; an event at the reference's own instant
    counts. Repeated rows of `refs` stay repeated; without events every dated reference is `missing`.
    """
    hour = F.date_trunc("hour", "at")
    dated = refs.where("lang is not null and key is not null and at is not null").withColumn("hour", hour)
    rest = refs.where("lang is null or key is null or at is null")

    by_hour = (
        events.withColumn("hour", hour)
        .select(*PARENT, "hour", "at", "present", F.lit(False).alias("asked"))
        .unionByName(dated.select(*PARENT, "hour", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("int").alias("present"), F.lit(True).alias("asked")))
        .groupBy(*PARENT, "hour")
        .agg(
            F.max(F.struct("at", "present")).alias("last"),
            F.min(F.when(F.col("present") == 1, F.col("at"))).alias("first_there"),
            F.max("asked").alias("asked"),
        )
    )
    before = Window.partitionBy(*PARENT).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        by_hour.withColumn("carried", F.last("last.present", ignorenulls=True).over(before))
        .withColumn("first_there", F.min("first_there").over(Window.partitionBy(*PARENT)))
        .where("asked")
        .select(*PARENT, "hour", "carried", "first_there")
    )

    # One stream per key and hour: the carried state, then the hour's events, then references of the same instant.
    stream = (
        carried.select(*PARENT, "hour", F.col("hour").alias("at"), F.lit(0).alias("turn"), F.coalesce("carried", F.lit(0)).alias("present"), "first_there", F.lit(None).cast(refs.schema["row_id"].dataType).alias("row_id"), F.lit(None).cast("string").alias("tab"))
        .unionByName(
            events.withColumn("hour", hour).select(*PARENT, "hour", "at", (1 + F.col("present")).alias("turn"), "present"),
            allowMissingColumns=True,
        )
        .unionByName(dated.select(*PARENT, "hour", "at", F.lit(3).alias("turn"), "row_id", "tab"), allowMissingColumns=True)
    )
    so_far = Window.partitionBy(*PARENT, "hour").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = (
        stream.withColumn("there", F.last("present", ignorenulls=True).over(so_far))
        .withColumn("first_there", F.last("first_there", ignorenulls=True).over(so_far))
        .where("turn = 3")
    )
    status = (
        F.when(F.col("there") == 1, FOUND)
        .when(F.col("first_there").isNull(), MISSING)
        .when(F.col("first_there") > F.col("at"), LATE)
        .otherwise(DELETED)
    )
    columns = ["tab", "row_id", "target", "lang", "key", "at"]
    lacking = F.when(F.col("lang").isNull() | F.col("key").isNull(), EMPTY).otherwise(UNDATED)
    return merged.select(*columns, status.alias("status")).unionByName(rest.select(*columns, lacking.alias("status")))


def orphans(resolved: DataFrame) -> DataFrame:
    """The references that name a record which was not there."""
    return resolved.where(F.col("status").isin(MISSING, DELETED, LATE))


def orphan_report(resolved: DataFrame) -> DataFrame:
    """References by table and month (null for undated ones) and status, as counts."""
    return resolved.groupBy("tab", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_references"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (FOUND, MISSING, DELETED, LATE, EMPTY, UNDATED)),
    )


def judged_claims(resolved: DataFrame, judgments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per build, the missing judged passages that its manifest claims beside those that its judgments show.

    resolved: of the judgments; judgments: (row_id, build_id); manifest: (build_id, n_judged_docs_missing).
    A build without judgments observes none; claims of null stay null, and `refuted` with them.
    """
    seen = (
        resolved.join(judgments, "row_id")
        .where(F.col("status") != EMPTY)
        .groupBy("build_id", "lang", "key")
        .agg(F.min(F.when(F.col("status") == FOUND, 0).otherwise(1)).alias("absent"))
        .groupBy("build_id")
        .agg(F.count(F.lit(1)).alias("n_judged"), F.sum("absent").alias("n_absent"))
    )
    return manifest.join(seen, "build_id", "left").select(
        "build_id",
        F.col("n_judged_docs_missing").cast("bigint").alias("n_claimed_missing"),
        F.coalesce("n_judged", F.lit(0)).alias("n_judged"),
        F.coalesce("n_absent", F.lit(0)).alias("n_observed_missing"),
        (F.col("n_judged_docs_missing") != F.coalesce("n_absent", F.lit(0))).alias("refuted"),
    )
