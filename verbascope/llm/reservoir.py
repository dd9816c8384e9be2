"""Samples of fixed size, drawn in one pass from streams whose length nobody knows.

A shard is a hash class of the keys, one task's, and its rows come sorted, so that draws depend on nothing
but seed, data and the number of shards. The task keeps a geometric file for each stratum of its shard:
accepted records gather in a buffer, and a full buffer is written in random order as a run of segments, each
smaller than the one before by the same factor, in place of records of older runs. A run is in random order,
so giving up its last records gives up random ones: whole segments fall away, smallest first, and nothing is
read or rewritten. Segments are files in the folder that all executors share; only a run's last, smallest
ones stay in memory. The shards' samples are then merged: how many records each shard contributes is a
hypergeometric draw weighted by the shards' populations, and which ones is a random prefix of its sample.
"""

from __future__ import annotations

import pickle
import random
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import counted_side, materialise, shared_folder

#: A sample of at most so many rows, each a stratum and a key, is broadcast to fetch its texts; a larger one is joined by shuffle.
BROADCAST_ROWS = 250_000
#: Records of a segment from which on it is a file.
LEAST_SEGMENT = 32


class MemorySegments:
    """Segments kept as they are: a run's smallest ones, and those of tests."""

    def write(self, records: list) -> list:
        return records

    def read(self, segment: list) -> list:
        return segment

    def drop(self, segment: list) -> None:
        pass


class FolderSegments:
    """Segments of at least `least` records as files in a folder that all executors share, by URI; smaller ones stay in memory.

    A folder is one attempt's of one task: an attempt that fails leaves nothing another one reads.
    """

    def __init__(self, uri: str, name: str, least: int = LEAST_SEGMENT):
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(uri)
        self.path, self.least, self.written = f"{path}/{name}", least, 0
        self.files.create_dir(self.path, recursive=True)

    def write(self, records: list) -> str | list:
        if len(records) < self.least:
            return records
        name = f"{self.path}/{self.written}"
        self.written += 1
        with self.files.open_output_stream(name) as out:
            out.write(pickle.dumps(records))
        return name

    def read(self, segment: str | list) -> list:
        if isinstance(segment, list):
            return segment
        with self.files.open_input_stream(segment) as source:
            return pickle.loads(source.read())

    def drop(self, segment: str | list) -> None:
        if isinstance(segment, str):
            self.files.delete_file(segment)

    def close(self) -> None:
        self.files.delete_dir(self.path)


class GeometricFile:
    """A uniform sample of `size` of all records offered so far."""

    def __init__(self, size: int, buffer: int, rng, segments) -> None:
        if size < 1 or buffer < 1:
            raise ValueError("size and buffer must be positive")
        self.size, self.capacity, self.rng, self.segments = size, min(buffer, size), rng, segments
        self.seen, self.stored, self.buffer = 0, 0, []
        #: Runs of [segment, records still alive in it], the largest segment first.
        self.runs: list[list[list]] = []

    def accept(self, n: int) -> list[int]:
        """Which of the next `n` records may enter, in order; `add` must be called for each before more are offered."""
        import numpy as np

        ordinals = np.arange(self.seen + 1, self.seen + n + 1)
        self.seen += n
        return np.flatnonzero(self.rng.random(n) * ordinals < self.size).tolist()

    def add(self, record) -> None:
        if self.stored + len(self.buffer) < self.size:
            self.buffer.append(record)
        else:
            # Of the `size` records that may be replaced, the buffered ones are replaced at once, others on flushing.
            place = int(self.rng.integers(self.size))
            if place < len(self.buffer):
                self.buffer[place] = record
            else:
                self.buffer.append(record)
        if len(self.buffer) >= self.capacity:
            self.flush()

    def flush(self) -> None:
        """The buffer becomes a run; where the file would grow too long, older runs give up random records."""
        n = len(self.buffer)
        if not n:
            return
        surplus = self.stored + n - self.size
        if surplus > 0:
            lengths = [sum(alive for _, alive in run) for run in self.runs]
            for run, victims in zip(self.runs, self.rng.multivariate_hypergeometric(lengths, surplus, method="marginals").tolist()):
                while victims:
                    segment, alive = run[-1]
                    gone = min(victims, alive)
                    victims -= gone
                    if gone == alive:
                        self.segments.drop(segment)
                        run.pop()
                    else:
                        run[-1][1] = alive - gone
            self.runs = [run for run in self.runs if run]
        order = self.rng.permutation(n)
        run, start = [], 0
        while start < n:  # each segment takes the share that a flush replaces of what is left
            length = max(1, round((n - start) * self.capacity / self.size))
            run.append([self.segments.write([self.buffer[i] for i in order[start : start + length]]), min(length, n - start)])
            start += length
        self.runs.append(run)
        self.stored = min(self.size, self.stored + n)
        self.buffer = []

    def records(self) -> list:
        """The sample in random order; its segments are given up."""
        self.flush()
        live = []
        for run in self.runs:
            for segment, alive in run:
                live += self.segments.read(segment)[:alive]
                self.segments.drop(segment)
        self.runs, self.stored = [], 0
        self.rng.shuffle(live)
        return live


def hypergeometric_shares(populations: list[int], size: int, rng: random.Random) -> list[int]:
    """How many of `size` records drawn without replacement come from each population; exact for any population."""
    from bisect import bisect_right
    from itertools import accumulate

    total = sum(populations)
    if size >= total:
        return list(populations)
    ends, shares = list(accumulate(populations)), [0] * len(populations)
    for place in rng.sample(range(total), size):
        shares[bisect_right(ends, place)] += 1
    return shares


def shard_samples(df: DataFrame, stratum: str, key: str, size: int, seed: int, buffer: int, folder: str, shards: int) -> DataFrame:
    """(stratum, shard, place, key, population): each shard's samples; a row of place -1 gives the population.

    Rows are hashed to `shards` tasks and sorted there, so a task has one file open at a time.
    """

    def shard(source: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId()
        segments = FolderSegments(folder, f"{number}-{context.attemptNumber()}-{uuid.uuid4().hex}")
        own = value = names = None

        def finished():
            records = own.records()
            n = len(records) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([value] * n, names[0].type), pa.array([number] * n, pa.int32()), pa.array([-1, *range(n - 1)], pa.int64()), pa.array([None, *records], names[1].type), pa.array([own.seen] * n, pa.int64())],
                names=[stratum, "shard", "place", key, "population"],
            )

        try:
            for batch in source:
                names = batch.schema
                for run in batch.column(0).dictionary_encode().dictionary.to_pylist():  # in order, each once
                    rows = batch.column(1).filter(pa.compute.equal(batch.column(0), pa.scalar(run, names[0].type)))
                    if own is None or run != value:
                        if own is not None:
                            yield finished()
                        own, value = GeometricFile(size, buffer, np.random.default_rng([seed, number, zlib.crc32(repr(run).encode())]), segments), run
                    for i in own.accept(len(rows)):
                        own.add(rows[i].as_py())
            if own is not None:
                yield finished()
        finally:
            segments.close()

    kinds = {c: df.schema[c].dataType.simpleString() for c in (stratum, key)}
    ordered = df.select(stratum, key).repartition(shards, stratum, key).sortWithinPartitions(stratum, key)
    return ordered.mapInArrow(shard, f"`{stratum}` {kinds[stratum]}, shard int, place bigint, `{key}` {kinds[key]}, population bigint")


def fixed_size_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int = 0, buffer: int = 4096, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """(stratum, key) of `size` rows of each stratum, every row equally likely; all rows of a smaller stratum.

    Rows with a null stratum or key are not sampled; repeated rows count as often as they occur, and those of one
    key pass through one task, so keys that repeat much should be merged first. A task keeps
    `size` keys of one stratum, in `folder` (a URI that all executors share, by default the checkpoint
    folder) beyond `buffer` of them. The same rows, seed and number of `shards` (by default the session's
    shuffle partitions) give the same sample, whatever the order and partitioning of `df`.
    """
    from pyarrow import fs

    there = df.where(F.col(stratum).isNotNull() & F.col(key).isNotNull())
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = f"{folder or shared_folder(df.sparkSession)}/segments-{uuid.uuid4().hex}"
    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)
    try:
        samples = materialise(shard_samples(there, stratum, key, size, seed, buffer, root, shards))
    finally:
        files.delete_dir(path)  # with what lost executors left

    def allot(pdf):
        rng = random.Random(f"{seed}:{pdf[stratum].iloc[0]}")
        pdf = pdf.sort_values("shard")
        return pdf.assign(share=hypergeometric_shares(pdf["population"].tolist(), size, rng))[[stratum, "shard", "share"]]

    kind = df.schema[stratum].dataType.simpleString()
    shares = samples.where("place = -1").select(stratum, "shard", "population").groupBy(stratum).applyInPandas(allot, f"`{stratum}` {kind}, shard int, share bigint")
    return samples.where("place >= 0").join(shares, [stratum, "shard"]).where("place < share").select(stratum, key)


def fetch(sample: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose `key` is in `sample`; the sample is broadcast only if counting shows that it is small."""
    sample, _ = counted_side(sample, BROADCAST_ROWS)
    return df.join(sample, key)
