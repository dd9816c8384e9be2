"""Seeded samples by hash order, judged documents first, and the manifest of a sub-corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..plans.materialise import counted_side


def lot(seed: int, *parts: Column) -> Column:
    """The place of a record in a seeded order that depends on nothing but its key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


#: Rows a group up to which Spark itself keeps the first ones of every map task.
GROUP_LIMIT = 1000


def bottom_k(df: DataFrame, by: str, key: str, k: int, seed: int) -> DataFrame:
    """At most `k` rows a group, uniform without replacement: those whose hashes come first; ties by key.

    Up to GROUP_LIMIT rows, every map task keeps only its first `k` a group before the shuffle. For more, rows are counted
    by group and a share of the hashes is kept that holds `k` of them with ten standard deviations to spare; only
    these, little more than `k` a group, are sorted.
    """
    lots = df.withColumn("_lot", lot(seed, F.col(by), F.col(key)))
    if k > GROUP_LIMIT:
        sizes, _ = counted_side(df.groupBy(by).agg(F.least(F.lit(1.0), F.lit(k + 10 * k**0.5) / F.count(F.lit(1))).alias("_share")))
        part = F.conv(F.substring("_lot", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        lots = lots.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).where(part <= F.col("_share")).drop("_by", "_share")
    placed = lots.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy("_lot", key)))
    return placed.where(F.col("_place") <= k).drop("_lot", "_place")


def sub_corpus(corpus: DataFrame, judged: DataFrame, target: int, seed: int) -> DataFrame:
    """(lang, docid, judged): all judged passages that exist, and others by lot up to `target` a language.

    corpus: (lang, docid), one row a passage; judged: (lang, docid), distinct. Where more are judged than
    `target`, nothing is added and nothing judged is dropped; `manifest` shows it.
    """
    marked = corpus.select("lang", "docid").join(judged.withColumn("judged", F.lit(True)), ["lang", "docid"], "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
    kept = marked.where("judged")
    room = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))
    others = bottom_k(marked.where("not judged"), "lang", "docid", target, seed).join(room, "lang", "left")
    order = Window.partitionBy("lang").orderBy(lot(seed, F.col("lang"), F.col("docid")), "docid")
    filled = others.withColumn("place", F.row_number().over(order)).where(F.col("place") + F.coalesce("n_kept", F.lit(0)) <= target)
    return kept.unionByName(filled.select("lang", "docid", "judged"))


def missing_judged(corpus: DataFrame, judged: DataFrame) -> DataFrame:
    """(lang, docid): judged passages that the corpus lacks."""
    return judged.select("lang", "docid").join(corpus.select("lang", "docid"), ["lang", "docid"], "left_anti")


def first_missing(missing: DataFrame, n: int = 20) -> DataFrame:
    """(lang, missing_judged_sample): the first `n` missing docids a language, sorted."""
    order = Window.partitionBy("lang").orderBy("docid")
    few = missing.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return few.groupBy("lang").agg(F.array_sort(F.collect_list("docid")).alias("missing_judged_sample"))


def sorted_digest(distinct: DataFrame, by: str, key: str) -> DataFrame:
    """(by, n_keys, sha256) with the SHA-256 of each group's keys, sorted and joined by line feeds.

    Such a digest takes its keys one after the other. Each group passes through one task, sorted by Spark and
    hashed row by row; no group is held in memory. Null groups and keys have no digest.
    """

    def batches(source):
        import hashlib

        import pyarrow as pa

        group, digest, n, found = None, None, 0, []
        for batch in source:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != group:
                    if digest is not None:
                        found.append((group, n, digest.hexdigest()))
                    group, digest, n = own, hashlib.sha256(), 0
                else:
                    digest.update(b"\n")
                digest.update(value.encode())
                n += 1
        if digest is not None:
            found.append((group, n, digest.hexdigest()))
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=[by, "n_keys", "sha256"])

    keys = distinct.select(F.col(by).cast("string").alias(by), F.col(key).cast("string").alias(key)).where(F.col(by).isNotNull() & F.col(key).isNotNull())
    return keys.repartition(by).sortWithinPartitions(by, key).mapInArrow(batches, f"`{by}` string, n_keys bigint, sha256 string")


def manifest(chosen: DataFrame, judged: DataFrame, target: int) -> DataFrame:
    """One row a language over a sub-corpus and the judged docids."""
    expected = judged.groupBy("lang").agg(F.count(F.lit(1)).alias("n_judged_docs_expected"))
    own = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n_actual"), F.count_if("judged").alias("n_judged_docs_found")).join(sorted_digest(chosen, "lang", "docid").select("lang", F.col("sha256").alias("docid_sha256")), "lang")
    zero = F.lit(0).cast("bigint")
    return own.join(expected, "lang", "left").select(
        "lang",
        F.lit(target).alias("n_target"),
        "n_actual",
        F.coalesce("n_judged_docs_expected", zero).alias("n_judged_docs_expected"),
        "n_judged_docs_found",
        (F.coalesce("n_judged_docs_expected", zero) - F.col("n_judged_docs_found")).alias("n_judged_docs_missing"),
        rounded(F.try_divide(F.col("n_judged_docs_found").cast("double"), F.col("n_actual")), 4).alias("judged_fraction"),
        "docid_sha256",
    )
