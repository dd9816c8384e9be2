"""The whole evaluation in stored steps: build, retrieve, evaluate, analyse, fertility.

    python -m verbascope.pipeline build retrieve evaluate analyse fertility --tables FOLDER --store FOLDER

Every step reads what earlier ones stored and makes only what is lacking, language by language, so that a run
may be stopped and started again, and languages may be added later.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import bm25, sampling
from .operators import evaluation as V
from .operators import fertility as Z
from .operators import statistics as S
from .plans.materialise import materialise
from .plans.store import Store
from .sources import collection as C

TARGET, SEED, TOKENISERS = 49_043, 20250317, ("char4", "word")


class Pipeline:
    """The steps over the tables in `tables`, with `target` passages a language; `languages` limits what a run makes."""

    def __init__(self, spark: SparkSession, tables: str, store: str, languages: list[str] | None = None, target: int = TARGET, tokenisers: tuple[str, ...] = TOKENISERS):
        self.spark, self.tables, self.store, self.languages, self.target, self.tokenisers = spark, tables, Store(spark, store), languages, target, tokenisers

    def _lacking(self, df: DataFrame, left: DataFrame) -> DataFrame:
        return df.join(left, "lang", "left_semi")

    def _wanted(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("lang").isin(*self.languages)) if self.languages else df

    def build(self) -> DataFrame:
        """The sub-corpus with its texts, and its manifest."""
        judged = C.judgments(self.spark, self.tables).select("lang", "docid").distinct()
        passages = C.passages(self.spark, self.tables)

        def corpus(left):
            own = self._lacking(passages, left)
            return own.join(sampling.sub_corpus(own, self._lacking(judged, left), self.target, SEED), ["lang", "docid"])

        stored = self.store.extend("corpus", self._wanted(passages), ["lang"], corpus)
        return self.store.extend("manifest", self._wanted(stored), ["lang"], lambda left: sampling.manifest(self._lacking(stored, left), self._lacking(judged, left), self.target))

    def retrieve(self) -> DataFrame:
        """BM25 by each tokeniser over the stored sub-corpus."""
        corpus, topics = self.store.read("corpus"), C.topics(self.spark, self.tables)
        normal = lambda df, text, key: df.select("lang", key, X.normalise(text).alias("norm"))
        for name in self.tokenisers:

            def run(left, name=name):
                documents = normal(self._lacking(corpus, left), X.passage_text(F.col("title"), F.col("text")), "docid")
                found = bm25.run_bm25(documents, normal(self._lacking(topics, left), F.col("text"), "qid"), name)
                return found.withColumns({"sys_name": F.lit(f"bm25-{name}"), "tokeniser": F.lit(name)})

            made = self.store.extend(f"run-{name}", self._wanted(corpus.select("lang")).join(topics.select("lang").distinct(), "lang", "left_semi"), ["lang"], run)
        return made

    def evaluate(self) -> DataFrame:
        """Scores of every query by every stored run."""
        judgments, topics = C.judgments(self.spark, self.tables), C.topics(self.spark, self.tables)
        for name in self.tokenisers:
            run = self.store.read(f"run-{name}")
            made = self.store.extend(
                f"per_query-{name}", self._wanted(run), ["lang"],
                lambda left, run=run, name=name: V.evaluate(self._lacking(run, left), self._lacking(judgments, left), self._lacking(topics, left)).withColumn("sys_name", F.lit(f"bm25-{name}")),
            )
        return made

    def analyse(self) -> DataFrame:
        """Differences of the last system from the first by language, with the bootstrap, and their pooled effect; made anew from what is stored."""
        first, second = (self.store.read(f"per_query-{name}").select("lang", "qid", F.round("ndcg10", 6).alias(name)) for name in (self.tokenisers[0], self.tokenisers[-1]))
        name = f"{self.tokenisers[-1]}__{self.tokenisers[0]}__ndcg10"
        diff = first.join(second, ["lang", "qid"]).select("lang", "qid", F.round(F.col(self.tokenisers[-1]) - F.col(self.tokenisers[0]), 6).alias("diff"))
        effects = self.store.replace("effects", materialise(S.paired_bootstrap(diff, ["lang"], ["qid"], seed=SEED).withColumn("comparison", F.lit(name))), ["comparison", "lang"])
        own = effects.where(F.col("comparison") == name).select("comparison", F.col("mean_diff").alias("y"), F.col("boot_se").alias("se"))
        return self.store.replace("pooled", materialise(S.random_effects(own, ["comparison"])), ["comparison"])

    def fertility(self) -> DataFrame:
        """How public vocabularies split the stored passages."""
        corpus = self.store.read("corpus")
        texts = corpus.select("lang", X.passage_text(F.col("title"), F.col("text")).alias("text"))
        return self.store.extend("fertility", self._wanted(corpus), ["lang"], lambda left: Z.measure_subwords(self._lacking(texts, left), ["lang"], "text"))


STEPS = ("build", "retrieve", "evaluate", "analyse", "fertility")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("steps", nargs="+", choices=STEPS)
    parser.add_argument("--tables", required=True)
    parser.add_argument("--store", required=True)
    parser.add_argument("--languages", help="codes with commas; by default all")
    parser.add_argument("--target", type=int, default=TARGET)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("verbascope").getOrCreate()
    pipeline = Pipeline(spark, given.tables, given.store, given.languages.split(",") if given.languages else None, given.target)
    for step in given.steps:
        print(f"{step}: {getattr(pipeline, step)().count()} rows")


if __name__ == "__main__":
    main()
