"""Exact search by cosine, vectors made by any encoder, and encoding that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import NUDGE
from ..functions.subwords import TOKENIZER_FOLDER, tokeniser
from .best import Best

#: Least norm that a vector is divided by, and places to which similarities are rounded before ranking.
LEAST_NORM, PLACES = 1e-12, 6
#: Least sum of a mask.
LEAST_MASK = 1e-9
#: Bytes of query vectors, and queries, that are broadcast as one block; more queries make more blocks.
BLOCK_BYTES, BLOCK_QUERIES = 32 << 20, 25_000
#: Similarities that a task computes at a time.
BATCH_SCORES = 2_000_000


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The inner product of two vectors of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """A vector of norm 1; of a zero vector, zeros."""
    own = as_double(vector)
    norm = F.greatest(F.sqrt(dot(own, own)), F.lit(LEAST_NORM))
    return F.transform(own, lambda x: x / norm)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is 1."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(LEAST_MASK))
    zero = F.transform(vectors[0], lambda _: F.lit(0.0))
    summed = F.aggregate(F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m)), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / total)


def cosine_top(queries: DataFrame, documents: DataFrame, depth: int) -> DataFrame:
    """(qid, docid, score, rank): the `depth` documents of the highest cosine for each query, ties by docid.

    queries: (qid, vec); documents: (docid, vec); a document of the query's own id is no hit. Queries are
    multiplied in blocks of bounded bytes with each batch of documents, and each task keeps the best `depth` of
    all its documents, so that what is shuffled is depth rows a query and task, never all pairs.
    Null vectors take no part.
    """
    asked = queries.where("qid is not null and vec is not null").select(F.col("qid").cast("bigint").alias("qid"), as_double(F.col("vec")).alias("vec"))
    stored = documents.where("docid is not null and vec is not null").select(F.col("docid").cast("bigint").alias("docid"), as_double(F.col("vec")).alias("vec"))
    width = asked.select(F.max(F.size("vec"))).first()[0] or 1
    rows = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * width)))
    count = asked.count()
    n_blocks = max(1, -(-count // rows))
    blocks = asked.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).alias("block"))
    result = None
    for block in range(n_blocks):  # a block is what one broadcast may hold; their number follows the stated query set
        held = blocks.where(F.col("block") == block).select("qid", "vec").collect()
        if not held:
            continue
        part = _block_candidates(stored, held, depth)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return asked.select("qid", F.col("qid").alias("docid"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def _block_candidates(stored: DataFrame, held: list, depth: int) -> DataFrame:
    import numpy as np

    shared = stored.sparkSession.sparkContext.broadcast((np.array([r.qid for r in held]), np.array([r.vec for r in held], float)))

    def batches(source: Iterator) -> Iterator:
        import pyarrow as pa

        qids, matrix = shared.value
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), LEAST_NORM)
        best, step = Best(len(qids), depth), max(1, BATCH_SCORES // len(qids))
        for batch in source:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for i in range(0, len(ids), step):
                part = own[i : i + step]
                part = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), LEAST_NORM)
                near = np.round(matrix @ part.T + NUDGE, PLACES)
                near[qids[:, None] == ids[None, i : i + step]] = -np.inf
                q, d = np.nonzero((near >= best.bar[:, None]) & np.isfinite(near))
                best.offer(q, ids[i + d], near[q, d])
        q, d, s = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["qid", "docid", "score"])

    return stored.mapInArrow(batches, "qid bigint, docid bigint, score double")


def encode(df: DataFrame, keys: list[str], text: str, encoder: Callable[[list[str]], list[list[float]]], prefix: str = "", batch_size: int = 16) -> DataFrame:
    """(*keys, vec float32) by a pluggable encoder, in batches of texts of similar length; null texts are read as empty.

    Texts are sorted by length within a partition, so that little is padded; the key travels with its row.
    """

    def batches(source: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in source:
            texts = [prefix + (t or "") for t in batch.column(len(keys)).to_pylist()]
            vectors = []
            for i in range(0, len(texts), batch_size):
                vectors += [[float(x) for x in v] for v in encoder(texts[i : i + batch_size])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(vectors, pa.list_(pa.float32()))], names=[*keys, "vec"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    ordered = df.select(*keys, F.col(text).alias("_text")).sortWithinPartitions(F.length("_text"), *keys)
    return ordered.mapInArrow(batches, f"{kinds}, vec array<float>")


def pooling_encoder(vocabulary: str, folder: str = TOKENIZER_FOLDER, width: int = 64, window: int = 256, seed: int = 0) -> Callable[[list[str]], list[list[float]]]:
    """An encoder's pass over a batch: token ids cut to `window`, padded to the longest, a vector a token, the mean under the mask, norm 1.

    The token vectors are drawn by `seed` where a model's weights would be read; a text without tokens has the zero vector.
    """

    def run(texts: list[str]) -> list[list[float]]:
        import numpy as np

        ids = [tokeniser(vocabulary, folder)(t)[:window] for t in texts]
        longest = max(1, max(map(len, ids), default=1))
        padded, mask = np.zeros((len(ids), longest), int), np.zeros((len(ids), longest))
        for i, own in enumerate(ids):
            padded[i, : len(own)], mask[i, : len(own)] = own, 1
        vectors = token_vectors(int(padded.max(initial=0)) + 1, width, seed)[padded]
        mean = (vectors * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), LEAST_MASK)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), LEAST_NORM)).tolist()

    return run


_vectors: dict = {}


def token_vectors(n: int, width: int, seed: int):
    """The vectors of at least the first `n` tokens, each drawn by itself, kept by the worker."""
    import numpy as np

    own = _vectors.get((width, seed))
    if own is None or len(own) < n:
        own = _vectors[width, seed] = np.random.default_rng(seed).standard_normal((1 << max(16, (n - 1).bit_length()), width))
    return own


def hashing_encoder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An encoder without weights: signed character trigrams, hashed and brought to norm 1. It stands in where no model is installed."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        vectors = np.zeros((len(texts), width))
        for row, text in zip(vectors, texts):
            for i in range(max(1, len(text) - 2)):
                h = zlib.crc32(text[i : i + 3].encode())
                row[h % width] += 1 if h >> 31 else -1
        return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), LEAST_NORM)).tolist()

    return run


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be encoded: the wanted rows whose keys are not done."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
