"""Token budgets: how many tokens each text has, and how many each slice of a corpus offers.

Whole texts are hashed and deduplicated, each distinct text is tokenised once, and its count is joined back
to the slices in which it occurs, as often as it occurs there. Only hashes and counts are shuffled for the
slices; copies of a text are merged before its text is shuffled, so a text that fills a third of the rows
costs one row a map task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.subwords import TOKENIZER_FOLDER, counter

#: Two 64-bit hashes with different salts make the 128-bit identity of a text.
HASH = ["h1", "h2"]


def with_hash(df: DataFrame, text: str) -> DataFrame:
    """`df` with the 128-bit hash of `text`, null for a null or empty text."""
    there = F.length(text) > 0
    return df.withColumns({"h1": F.when(there, F.xxhash64(text)), "h2": F.when(there, F.xxhash64(F.lit("second"), text))})


def count_distinct_texts(hashed: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """(h1, h2, n_tokens) once for each distinct text."""

    def batches(source: Iterator) -> Iterator:
        import pyarrow as pa

        count = counter(name, folder)
        for batch in source:
            n = pa.array([count(x.as_py()) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=[*HASH, "n_tokens"])

    distinct = hashed.where("h1 is not null").select(*HASH, F.col(text).alias("text")).dropDuplicates(HASH)
    return distinct.mapInArrow(batches, "h1 bigint, h2 bigint, n_tokens bigint")


def token_counts(df: DataFrame, keys: list[str], text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """(*keys, n_tokens) for every row of `df`; 0 for a null or empty text."""
    hashed = with_hash(df, text)
    counts = count_distinct_texts(hashed, text, name, folder)
    return hashed.select(*keys, *HASH).join(counts, HASH, "left").select(*keys, F.coalesce("n_tokens", F.lit(0).cast("bigint")).alias("n_tokens"))


def token_totals(df: DataFrame, slices: list[str], text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """(*slices, n_texts, n_distinct, n_tokens, n_distinct_tokens): what each slice holds, with and without its copies.

    Null and empty texts count as texts of no tokens and as no distinct text; null slice values make a slice of their own.
    """
    hashed = with_hash(df, text)
    occurrences = hashed.groupBy(*slices, *HASH).agg(F.count(F.lit(1)).alias("times"))
    counts = count_distinct_texts(hashed, text, name, folder)
    n = F.coalesce("n_tokens", F.lit(0).cast("bigint"))
    return (
        occurrences.join(counts, HASH, "left")
        .groupBy(*slices)
        .agg(
            F.sum("times").alias("n_texts"),
            F.count("h1").alias("n_distinct"),
            F.sum(n * F.col("times")).alias("n_tokens"),
            F.sum(n).alias("n_distinct_tokens"),
        )
    )


def plain_language(lang: Column) -> Column:
    """A language code as it is meant: `EN` and `en-x` are `en`; blanks are null."""
    bare = F.lower(F.substring_index(F.trim(lang), "-", 1))
    return F.when(bare != "", bare)


def plain_name(name: Column) -> Column:
    """A name in lower case without blanks at its ends; blanks are null."""
    bare = F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare != "", bare)
