"""Outcomes of queries by system: categories, transitions between two systems, exposure to unjudged documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded

#: Names of the outcomes, from the worst to the best.
CATEGORIES = ["total_miss", "deep_miss", "weak_rank", "rank1"]
#: Outcomes with nothing relevant among the first ten.
MISSES = CATEGORIES[:2]


def category(ndcg: Column, recall: Column, mrr: Column) -> Column:
    """Nothing relevant among the first hundred; none among the first ten; none at the top; else the best."""
    total, deep, weak, best = map(F.lit, CATEGORIES)
    return F.when(recall == 0, total).when(ndcg == 0, deep).when(mrr < 1.0, weak).otherwise(best)


def with_category(scores: DataFrame) -> DataFrame:
    """`scores` with `category`; null scores count as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return scores.withColumn("category", category(zero("ndcg10"), zero("recall100"), zero("mrr10")))


def failure_rates(scores: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, n_<category>, rate_<category>) by group."""
    counted = with_category(scores).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES))
    return counted.select(*by, "n", *(f"n_{c}" for c in CATEGORIES), *(rounded(F.col(f"n_{c}") / F.col("n"), 4).alias(f"rate_{c}") for c in CATEGORIES))


def paired(scores: DataFrame, first: str, second: str) -> DataFrame:
    """(lang, qid, a, b): the scores of two systems on the queries that both have; a and b are structs."""
    row = F.struct("ndcg10", "recall100", "mrr10", "n_positives", "unjudged10", "unjudged100")
    side = lambda name, alias: scores.where(F.col("sys_name") == name).select("lang", "qid", row.alias(alias))
    return side(first, "a").join(side(second, "b"), ["lang", "qid"])


def pair_coverage(scores: DataFrame, first: str, second: str) -> DataFrame:
    """(lang, n_both, n_first_only, n_second_only): whether two systems have the same queries."""
    own = scores.where(F.col("sys_name").isin(first, second)).groupBy("lang", "qid").agg(F.max(F.col("sys_name") == first).alias("a"), F.max(F.col("sys_name") == second).alias("b"))
    return own.groupBy("lang").agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") & ~F.col("b")).alias("n_first_only"), F.count_if(~F.col("a") & F.col("b")).alias("n_second_only"))


def transitions(pairs: DataFrame) -> DataFrame:
    """(lang, from_cat, to_cat, n): how queries move between categories from one system to the other."""
    cat = lambda x: category(*(F.coalesce(F.col(f"{x}.{c}"), F.lit(0.0)) for c in ("ndcg10", "recall100", "mrr10")))
    return pairs.groupBy("lang", cat("a").alias("from_cat"), cat("b").alias("to_cat")).agg(F.count(F.lit(1)).alias("n"))


def rescued_and_broken(moves: DataFrame) -> DataFrame:
    """(lang, n, n_rescued, n_broken, rates): queries whose miss the second system mends, and those it loses."""
    miss = lambda c: F.col(c).isin(*MISSES)
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    counted = moves.groupBy("lang").agg(total(miss("from_cat") & ~miss("to_cat")).alias("n_rescued"), total(~miss("from_cat") & miss("to_cat")).alias("n_broken"), F.sum("n").alias("n"))
    rate = lambda c: rounded(F.col(c) / F.col("n"), 4)
    return counted.select("lang", "n", "n_rescued", "n_broken", rate("n_rescued").alias("rescued_rate"), rate("n_broken").alias("broken_rate"), rounded((F.col("n_rescued") - F.col("n_broken")) / F.col("n"), 4).alias("net_rate"))


def exposure(pairs: DataFrame) -> DataFrame:
    """(lang, n, first_unjudged10, second_unjudged10, difference): which system shows more documents nobody judged."""
    both = pairs.where("a.unjudged10 is not null and b.unjudged10 is not null")
    return both.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg("a.unjudged10"), 3).alias("first_unjudged10"),
        rounded(F.avg("b.unjudged10"), 3).alias("second_unjudged10"),
        rounded(F.avg(F.col("b.unjudged10") - F.col("a.unjudged10")), 3).alias("difference"),
    )


def exposure_summary(by_language: DataFrame) -> DataFrame:
    """One row over the languages of `exposure`."""
    return by_language.agg(
        F.count(F.lit(1)).alias("k"),
        rounded(F.avg("difference"), 4).alias("mean_difference"),
        F.min("difference").alias("min_difference"),
        F.max("difference").alias("max_difference"),
        F.count_if(F.col("difference") > 0).alias("n_second_higher"),
    )
