"""Artifacts that grow by finished parts, so that a run which stops goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def finished(spark: SparkSession, folder: str) -> list[str]:
    """The folders v... below `folder` whose writing has ended, the latest last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().getParent().toString() for f in found)


def next_part(spark: SparkSession, folder: str) -> str:
    """A folder for a further part; what an earlier attempt left there without ending is overwritten."""
    parts = finished(spark, folder)
    return f"{folder}/v{int(parts[-1].rpartition('/v')[2]) + 1 if parts else 0:08d}"


class Store:
    """Named artifacts below one folder that all executors share. One run at a time adds to an artifact."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str) -> DataFrame | None:
        """All finished parts of an artifact; none if there is none."""
        parts = finished(self.spark, f"{self.root}/{name}")
        return self.spark.read.parquet(*parts) if parts else None

    def extend(self, name: str, wanted: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The artifact after `make` has been asked for those keys of `wanted` that it lacks; nothing is made where none is lacking.

        make: distinct keys to rows that have these keys; a key without rows is asked for again.
        """
        own = self.read(name)
        left = wanted.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()
        if own is not None:
            left = left.join(own.select(*keys).distinct(), keys, "left_anti")
        if not left.isEmpty():
            self._write(name, make(left))
        return self.read(name)

    def replace(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The artifact with `rows` in place of those of the same keys: one new part, after which the older ones are deleted."""
        from ..sources.files import upsert

        own, older = self.read(name), finished(self.spark, f"{self.root}/{name}")
        self._write(name, rows if own is None else upsert(own.drop("made_utc"), rows, keys))
        for part in older:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(part)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.read(name)

    def _write(self, name: str, rows: DataFrame) -> None:
        made = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        rows.withColumn("made_utc", made).write.mode("overwrite").parquet(next_part(self.spark, f"{self.root}/{name}"))
