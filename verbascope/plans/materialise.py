"""Cutting lineage so that lost executors cost a re-read, not a re-run."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: `spark.checkpoint.dir`. Where it is unset, one is made for a session of one process; on a cluster it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="verbascope-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def passing_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder below the shared one, deleted when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{path}/own"


def materialise(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared checkpoint folder. Schema and rows are unchanged; order is not kept."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def counted_side(df: DataFrame, most: int = 10_000) -> tuple[DataFrame, bool]:
    """`df` materialised, and whether counting shows at most `most` rows; if so it is marked for broadcast.

    For the side of a join that has a row a language or the like: the other side then stays where it is, and
    no key of it becomes one task's.
    """
    kept = materialise(df)
    few = kept.limit(most + 1).count() <= most
    return (F.broadcast(kept) if few else kept), few
