"""Scores of rankings against judgments, in one pass: nDCG@10, Recall@100, MRR@10 and unjudged counts.

Gain is linear in the grade; the ideal ranking takes all positive judgments of a query, retrieved or not. A
query without positive judgments scores 0 and still counts. A judgment of 0 is a judgment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded

DEPTH, CUT = 100, 10


def discounted(gain: Column, rank: Column) -> Column:
    """A gain at a rank from 1."""
    return gain / F.log2(rank + F.lit(1.0))


def ideal(judgments: DataFrame) -> DataFrame:
    """(lang, qid, n_positives, idcg) of queries that have positive judgments."""
    best = Window.partitionBy("lang", "qid").orderBy(F.desc("rel"), "docid")
    ordered = judgments.where("rel > 0").withColumn("place", F.row_number().over(best))
    gain = F.when(F.col("place") <= CUT, discounted(F.col("rel"), F.col("place")))
    return ordered.groupBy("lang", "qid").agg(F.count(F.lit(1)).alias("n_positives"), F.sum(gain).alias("idcg"))


def evaluate(run: DataFrame, judgments: DataFrame, topics: DataFrame) -> DataFrame:
    """(lang, qid, ndcg10, recall100, mrr10, n_positives, unjudged10, unjudged100) for every topic."""
    seen = run.where(F.col("rank") <= DEPTH).select("lang", "qid", "docid", "rank").join(judgments, ["lang", "qid", "docid"], "left")
    positive, near = F.col("rel") > 0, F.col("rank") <= CUT
    found = seen.groupBy("lang", "qid").agg(
        F.sum(F.when(positive & near, discounted(F.col("rel"), F.col("rank")))).alias("dcg"),
        F.count_if(positive).alias("hits"),
        F.min(F.when(positive & near, F.col("rank"))).alias("first"),
        F.count_if(F.col("rel").isNull() & near).alias("unjudged10"),
        F.count_if(F.col("rel").isNull()).alias("unjudged100"),
    )
    every = topics.select("lang", "qid").join(found, ["lang", "qid"], "left").join(ideal(judgments), ["lang", "qid"], "left")
    zero = F.lit(0).cast("bigint")
    return every.select(
        "lang",
        "qid",
        F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg10"),
        F.coalesce(F.col("hits") / F.col("n_positives"), F.lit(0.0)).alias("recall100"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr10"),
        F.coalesce("n_positives", zero).alias("n_positives"),
        F.coalesce("unjudged10", zero).alias("unjudged10"),
        F.coalesce("unjudged100", zero).alias("unjudged100"),
    )


def means(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean scores by group: 4 places, unjudged counts 3 and 2; unjudged counts that are null are not counted in."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        *(rounded(F.avg(c), 4).alias(c) for c in ("ndcg10", "recall100", "mrr10")),
        rounded(F.avg("unjudged10"), 3).alias("unjudged10"),
        rounded(F.avg("unjudged100"), 2).alias("unjudged100"),
    )
