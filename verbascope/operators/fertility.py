"""How tokenisers split words: fertility, share of whole words, tokens per character."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.subwords import TOKENIZER_FOLDER, counter
from ..functions.text import UNSEGMENTED, words

#: Public vocabularies that are measured, by the names of their files.
VOCABULARIES = ("byte_bpe_50k", "byte_bpe_multi_50k", "piece_bpe_32k", "word_bpe_49k")
#: Families by a word's length alone, which SQL can express: the number of tokens of a word of some length.
FAMILIES: dict[str, Callable[[Column], Column]] = {
    "char4": lambda w: F.greatest(F.length(w) - 3, F.lit(1)),
    "byte3": lambda w: F.ceil(F.octet_length(w) / 3).cast("int"),
    "whole": lambda w: F.lit(1),
}


def measure(df: DataFrame, by: list[str], text: str, families: dict[str, Callable[[Column], Column]] = FAMILIES) -> DataFrame:
    """(*by, family, n_words, n_chars, n_tokens, fertility, single_rate, tokens_per_char), ratios to 4 places.

    Words stand between blanks, with case and punctuation. Ratios of a group without words are null.
    """
    split = df.select(*by, F.explode(words(F.col(text))).alias("word"))
    families_of = F.array(*(F.struct(F.lit(name).alias("family"), count(F.col("word")).cast("bigint").alias("tokens")) for name, count in families.items()))
    each = split.select(*by, F.length("word").alias("chars"), F.explode(families_of).alias("f")).select(*by, "chars", "f.*")
    sums = each.groupBy(*by, "family").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("chars").cast("bigint").alias("n_chars"), F.sum("tokens").alias("n_tokens"), F.count_if(F.col("tokens") == 1).alias("n_single")
    )
    return with_ratios(sums, by)


def with_ratios(sums: DataFrame, by: list[str]) -> DataFrame:
    ratio = lambda a, b: rounded(F.try_divide(F.col(a).cast("double"), F.col(b)), 4)
    return sums.select(*by, "family", "n_words", "n_chars", "n_tokens", ratio("n_tokens", "n_words").alias("fertility"), ratio("n_single", "n_words").alias("single_rate"), ratio("n_tokens", "n_chars").alias("tokens_per_char"))


def word_measure_valid(lang: Column) -> Column:
    """Whether words stand between blanks in a language."""
    return ~lang.isin(*UNSEGMENTED)


def word_counts(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(*by, word, n): how often each word occurs after compatibility composition; counts are merged by batch and by map task before they are shuffled."""

    def batches(source):
        import unicodedata
        from collections import Counter

        import pyarrow as pa

        for batch in source:
            tally: Counter = Counter()
            for *group, value in zip(*(c.to_pylist() for c in batch.columns)):
                group = tuple(group)
                tally.update((group, w) for w in unicodedata.normalize("NFKC", value or "").split())
            groups = list(zip(*(g for g, _ in tally))) or [()] * len(by)
            yield pa.RecordBatch.from_arrays([*(pa.array(g, kind.type) for g, kind in zip(groups, batch.schema)), pa.array([w for _, w in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], names=[*by, "word", "n"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    counted = df.select(*by, F.col(text).alias("_text")).mapInArrow(batches, f"{kinds}, word string, n bigint")
    return counted.groupBy(*by, "word").agg(F.sum("n").alias("n"))


def measure_subwords(df: DataFrame, by: list[str], text: str, vocabularies: tuple[str, ...] = VOCABULARIES, folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """As `measure`, by public vocabularies: each distinct word of a group is tokenised once, after compatibility composition.

    Null and empty texts have no words, and groups without words no row.
    """

    def batches(source):
        import pyarrow as pa

        counts = {name: counter(name, folder) for name in vocabularies}
        for batch in source:
            words, n = batch.column(len(by)).to_pylist(), batch.column(len(by) + 1)
            for name, count in counts.items():
                tokens = pa.array([count(w) for w in words], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array([name] * len(words), pa.string()), pa.array([len(w) for w in words], pa.int64()), tokens, n], names=[*by, "family", "chars", "tokens", "n"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    each = word_counts(df, by, text).select(*by, "word", "n").mapInArrow(batches, f"{kinds}, family string, chars bigint, tokens bigint, n bigint")
    total = lambda x: F.sum(x * F.col("n"))
    sums = each.groupBy(*by, "family").agg(F.sum("n").alias("n_words"), total(F.col("chars")).alias("n_chars"), total(F.col("tokens")).alias("n_tokens"), total((F.col("tokens") == 1).cast("bigint")).alias("n_single"))
    return with_ratios(sums, by)


def outcome_profile(outcomes: DataFrame, topics: DataFrame, per_word: DataFrame) -> DataFrame:
    """(lang, outcome, n, mean_words, mean_chars, mean_tokens_per_word, mean_positives) of queries by outcome.

    outcomes: (lang, qid, outcome, n_positives); per_word: (lang, qid, per_word); a query without text counts in n only.
    """
    shaped = topics.select("lang", "qid", F.size(words(F.col("text"))).alias("n_words"), F.length("text").alias("n_chars"))
    joined = outcomes.join(shaped, ["lang", "qid"], "left").join(per_word, ["lang", "qid"], "left")
    mean = lambda c: rounded(F.avg(c), 3)
    return joined.groupBy("lang", "outcome").agg(F.count(F.lit(1)).alias("n"), mean("n_words").alias("mean_words"), mean("n_chars").alias("mean_chars"), mean("per_word").alias("mean_tokens_per_word"), mean("n_positives").alias("mean_positives"))


def per_word_by_length(topics: DataFrame) -> DataFrame:
    """(lang, qid, per_word): tokens a word by the family `char4`."""
    own = words(F.col("text"))
    tokens = F.aggregate(F.transform(own, FAMILIES["char4"]), F.lit(0), lambda s, x: s + x)
    return topics.select("lang", "qid", F.try_divide(tokens.cast("double"), F.size(own)).alias("per_word"))
