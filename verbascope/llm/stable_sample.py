"""A sample that stays: the same in every rerun and partitioning, and growing only by new records.

A record is in the sample if the salted hash of its key lies below its stratum's threshold. The hash depends
on nothing but salt, stratum and key; thresholds may be raised and never lowered. So a record that was chosen
once stays chosen whatever arrives later, and no record is compared with another: one narrow filter. The salt
and the threshold of a stratum are stored when they are first used; later runs read them, add new strata and
raise thresholds, and change nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import counted_side
from ..plans.store import finished, next_part

#: Hashes are the first 60 bits of a SHA-256.
SPACE = 1 << 60


def key_hash(salt: Column, stratum: Column, key: Column) -> Column:
    """A number below 2^60 that depends on salt, stratum and key alone."""
    digest = F.sha2(F.concat_ws(":", salt.cast("string"), stratum, key), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def threshold(rate: Column) -> Column:
    """The hash below which a share `rate` of all keys lies."""
    return F.floor(F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0)) * F.lit(float(SPACE))).cast("bigint")


def rules_in_force(wanted: DataFrame, stratum: str, folder: str) -> DataFrame:
    """(stratum, salt, threshold): the rules stored in `folder`, with new strata of `wanted` and its higher thresholds.

    wanted: (stratum, salt, threshold), one row a stratum; rows with a null among them are no rules. What is stored
    keeps its salt whatever `wanted` says, and a lower threshold changes nothing. A change is written as a further
    version beside the earlier ones, so a run that fails leaves the rules as they were.
    """
    spark = wanted.sparkSession
    new = wanted.select(stratum, "salt", "threshold").dropna()
    versions = finished(spark, folder)
    if versions:
        old = spark.read.parquet(versions[-1])
        both = old.withColumnsRenamed({"salt": "old_salt", "threshold": "old_threshold"}).join(new, stratum, "full_outer")
        new = both.select(stratum, F.coalesce("old_salt", "salt").alias("salt"), F.greatest("old_threshold", "threshold").alias("threshold"))
        if new.exceptAll(old).isEmpty():
            return old
    latest = next_part(spark, folder)
    new.write.mode("overwrite").parquet(latest)
    return spark.read.parquet(latest)


def stable_sample(df: DataFrame, stratum: str, key: str, salts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The rows of `df` whose key is chosen, with `key_hash`.

    salts: (stratum, salt); thresholds: (stratum, threshold); one row a stratum each. Rows with a null stratum
    or key, and strata without salt or threshold, are not sampled. Repeated rows are chosen together.
    """
    rules, _ = counted_side(salts.join(thresholds, stratum))
    rules = rules.select(F.col(stratum).alias("_stratum"), F.col("salt").alias("_salt"), F.col("threshold").alias("_threshold"))
    chosen = df.join(rules, F.col(stratum) == F.col("_stratum")).where(F.col(key).isNotNull())
    chosen = chosen.withColumn("key_hash", key_hash(F.col("_salt"), F.col("_stratum"), F.col(key)))
    return chosen.where("key_hash < _threshold").drop("_stratum", "_salt", "_threshold")


def fingerprint(distinct: DataFrame, by: list[str], key: str) -> DataFrame:
    """(*by, n_keys, fingerprint) of distinct keys: sums of their SHA-256 in eight parts, whatever their order.

    Sums merge before they are shuffled, so a group of any size is fingerprinted by all tasks together.
    """
    digest = F.sha2(F.col(key), 256)
    part = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
    sums = [F.sum(part(i)).alias(f"s{i}") for i in range(8)]
    text = F.concat_ws("", *(F.lpad(F.lower(F.hex(F.pmod(F.col(f"s{i}"), F.lit(1 << 32)))), 8, "0") for i in range(8)))
    return distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keys"), *sums).select(*by, "n_keys", text.alias("fingerprint"))
