"""Retrieval: tokens, BM25, exact cosine search (survey groups F, K, X, W and J of the retrieval path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions import text as X
from ..operators import bm25, dense
from ..operators.ranking import shard_of, with_place
from ..plans.materialise import materialise, passing_folder
from ..sources import collection as C
from ..sources.tables import table

SEEDED_QUERIES, BENCH_SEED = 300, 13


def corpus(spark: SparkSession, d: str, exact: bool = False) -> DataFrame:
    """(lang, docid, norm) of every passage."""
    norm = X.normalise_exact if exact else X.normalise
    return C.passages(spark, d).select("lang", "docid", norm(X.passage_text(F.col("title"), F.col("text"))).alias("norm"))


def topics(spark: SparkSession, d: str, exact: bool = False) -> DataFrame:
    norm = X.normalise_exact if exact else X.normalise
    return C.topics(spark, d).select("lang", "qid", norm(F.col("text")).alias("norm"))


def run(spark: SparkSession, d: str, tokeniser: str = "char4", exact: bool = False) -> DataFrame:
    return bm25.run_bm25(corpus(spark, d, exact), topics(spark, d, exact), tokeniser)


def _run(tokeniser: str, exact: bool = False):
    return lambda spark, d: run(spark, d, tokeniser, exact).withColumn("rank", F.col("rank").cast("bigint"))


def j04_scored(spark, d):
    """Documents that share a word with a query, by looking the postings of its words up; the best hundred."""
    own = bm25.run_bm25(corpus(spark, d), topics(spark, d), "word", 100, pad=False)
    return own.withColumn("rank", F.col("rank").cast("bigint"))


def x02_padded(spark, d):
    """The same, filled to a hundred with documents without a common word."""
    return bm25.run_bm25(corpus(spark, d), topics(spark, d), "word", 100).withColumn("rank", F.col("rank").cast("bigint"))


def f01_normalise(spark, d):
    return C.topics(spark, d).select("lang", "qid", X.normalise(F.col("text")).alias("norm"))


def f01_normalise_exact(spark, d):
    return C.topics(spark, d).select("lang", "qid", X.normalise_exact(F.col("text")).alias("norm"))


def f02_categories(spark, d):
    """Characters of each query by general category."""
    kinds = {"n_letters": r"\p{L}", "n_marks": r"\p{M}", "n_digits": r"\p{N}", "n_writing": r"[\p{P}\p{S}]"}
    count = lambda p: (F.length("text") - F.length(F.regexp_replace("text", p, ""))).cast("bigint")
    return C.topics(spark, d).select("lang", "qid", *(count(p).alias(n) for n, p in kinds.items()))


def f03_words(spark, d):
    return topics(spark, d).select("lang", "qid", X.words(F.col("norm")).alias("tokens"))


def f04_char4(spark, d):
    return topics(spark, d).select("lang", "qid", X.char_grams(F.col("norm"), 4).alias("tokens"))


def a04_lengths(spark, d):
    """Statistics of the collection by language."""
    own = corpus(spark, d)
    return bm25.collection_statistics(bm25.lengths(own, X.char_grams(F.col("norm"), 4))).select("lang", "n_docs", rounded("mean_length", 6).alias("mean_length"))


def a05_idf(spark, d):
    """Document frequency and floored idf of every word."""
    own = corpus(spark, d)
    tokens = X.words(F.col("norm"))
    idf = bm25.inverse_frequencies(bm25.postings(own, tokens), bm25.collection_statistics(bm25.lengths(own, tokens)))
    return idf.select("lang", "term", "df", rounded("idf", 6).alias("idf"))


def r05_synthetic(spark, d):
    """1500 made passages of 90 words of a vocabulary of 4000."""
    word = lambda i: F.concat(F.lit("tok"), F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(BENCH_SEED)), F.col("id").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(4000)).cast("string"))
    return spark.range(1500).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(90)), word), " ").alias("text"))


def r06_known_items(spark, d):
    """The first 8 words of each language's first 50 passages, as queries for them."""
    first = bm25.Window.partitionBy("lang").orderBy("docid")
    own = C.passages(spark, d).where("trim(text) <> ''").withColumn("place", F.row_number().over(first)).where("place <= 50")
    return own.select("lang", "docid", F.array_join(F.slice(X.words(F.col("text")), 1, 8), " ").alias("query"))


def x07_cosine(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vec"))
    asked = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "vec")
    return dense.cosine_top(asked, own.withColumnRenamed("vec_id", "docid"), 100).withColumn("rank", F.col("rank").cast("bigint"))


def f08_unit_vectors(spark, d):
    own = table(spark, d, "embeddings")
    return own.select("vec_id", rounded(dense.dot(dense.unit(F.col("embedding")), dense.unit(F.col("embedding"))), 6).alias("square"), rounded(dense.unit(F.col("embedding"))[0], 6).alias("first"))


def f09_dot(spark, d):
    """Each vector's cosine with its label's first vector."""
    own = table(spark, d, "embeddings").select("vec_id", "label", dense.as_double(F.col("embedding")).alias("v"))
    first = own.groupBy("label").agg(F.min_by("v", "vec_id").alias("w"))
    return own.join(first, "label").select("vec_id", rounded(dense.dot(F.col("v"), F.col("w")), 6).alias("similarity"))


def f08_masked_mean(spark, d):
    """The mean of each label's vectors of even number: sums by position, merged by map task."""
    own = table(spark, d, "embeddings").select("label", F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.0).alias("mask"), F.posexplode(dense.as_double(F.col("embedding"))).alias("i", "v"))
    means = own.groupBy("label", "i").agg((F.sum(F.col("v") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(dense.LEAST_MASK))).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("i", rounded("mean", 6).alias("mean"))))  # as many rows as a vector is wide
    return means.groupBy("label").agg(F.transform(ordered, lambda x: x["mean"]).alias("mean"))


def x04_encode(spark, d):
    """Vectors of the queries, with the prefix of queries: tokens cut to 256, padded, pooled under their mask and brought to norm 1."""
    return dense.encode(C.topics(spark, d), ["lang", "qid"], "text", dense.pooling_encoder("byte_bpe_multi_50k"), "query: ")


def x05_shards(spark, d):
    """Queries in order of length, 4 a shard within a language."""
    own = C.topics(spark, d).select("lang", "qid", F.length("text").cast("bigint").alias("n_chars"))
    return with_place(own, ["lang"], ["n_chars", "qid"]).select("lang", "qid", "n_chars", shard_of(F.col("place"), 4).alias("shard"))


def x06_remaining(spark, d):
    """Queries still to be encoded by a run that finds each language's first shard in its store."""
    store, own = passing_folder(spark, "vectors"), materialise(x05_shards(spark, d))
    first = C.topics(spark, d).join(own.where("shard = 0").select("lang", "qid"), ["lang", "qid"])
    dense.encode(first, ["lang", "qid"], "text", dense.pooling_encoder("byte_bpe_multi_50k"), "query: ").write.parquet(store)
    return dense.remaining(own, spark.read.schema("lang string, qid string, vec array<float>").parquet(store), ["lang", "qid"]).select("lang", "qid")


def x08_token_length(spark, d):
    """Tokens of each query, as a window of 256 sees them."""
    return topics(spark, d).select("lang", "qid", F.least(F.size(X.char_grams(F.col("norm"), 4)), F.lit(256)).cast("bigint").alias("n_tokens"))


NORM = X.normalise_sql(X.passage_text_sql())


def bm25_sql(tokeniser: str, pad: bool = True, depth: int = 100) -> str:
    """The body of a WITH clause that ends in `run`."""
    return f"{C.CTES}, {_search_sql(X.words_sql if tokeniser == 'word' else lambda e: X.char_grams_sql(e, tokeniser[4:]), pad, depth)}"


def sweep_sql() -> str:
    """The same for runs of 2 to 5 characters at once; languages are named `n/language`."""
    base = C.CTES
    for name in ("passages", "topics", "judgments"):
        base = base.replace(f"{name} as (", f"base_{name} as (", 1)
    every = ", ".join(f"{name} as (select t.n, b.* replace (t.n || '/' || lang as lang) from base_{name} b, range(2, 6) t(n))" for name in ("passages", "topics", "judgments"))
    return f"{base}, {every}, {_search_sql(lambda e: X.char_grams_sql(e, 'n'))}"


def _search_sql(tokens, pad: bool = True, depth: int = 100) -> str:
    return f"""corpus as (select lang, docid, {tokens(NORM)} tokens from passages),
      topic as (select lang, qid, {tokens(X.normalise_sql('text'))} tokens from topics),
      dl as (select lang, docid, len(tokens) length from corpus),
      stats as (select lang, count(*) n_docs, avg(length) mean_length from dl group by 1),
      post as (select lang, docid, term, count(*) tf from (select lang, docid, unnest(tokens) term from corpus) group by all),
      freq as (select lang, term, df, ln(n_docs - df + 0.5::double) - ln(df + 0.5::double) raw
        from (select lang, term, count(*) df from post group by all) join stats using (lang)),
      idf as (select lang, term, case when raw < 0 then 0.25::double * avg(raw) over (partition by lang) else raw end idf from freq),
      asked as (select lang, qid, term, count(*) qtf from (select lang, qid, unnest(tokens) term from topic) group by all),
      hits as (select p.lang, a.qid, p.docid, round(sum(i.idf * a.qtf * (p.tf * 2.5::double / (p.tf + 1.5::double * (0.25::double + 0.75::double * d.length / s.mean_length)))), 6) score
        from asked a join idf i using (lang, term) join post p using (lang, term) join dl d using (lang, docid) join stats s using (lang) group by all),
      top as (select *, row_number() over (partition by lang, qid order by score desc, docid) rank from hits qualify rank <= {depth}),
      pads as (select t.lang, t.qid, p.docid, 0::double score from topic t join (select lang, docid from passages qualify row_number() over (partition by lang order by docid) <= {depth}) p using (lang)
        where {'true' if pad else 'false'} and (t.lang, t.qid, p.docid) not in (select (lang, qid, docid) from top)),
      run as (select lang, qid, docid, score, row_number() over (partition by lang, qid order by score desc, docid) rank
        from (select lang, qid, docid, score from top union all select * from pads where (lang, qid) not in (select (lang, qid) from top group by lang, qid having count(*) >= {depth})) qualify rank <= {depth})"""


def _run_sql(tokeniser: str, pad: bool = True) -> str:
    return f"with {bm25_sql(tokeniser, pad)} select lang, qid, docid, score, rank from run"


_TOPIC = f"with {C.CTES}, topic as (select lang, qid, text, {X.normalise_sql('text')} norm from topics)"
_UNIT = "list_transform(embedding::double[], lambda x: x / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-12))"
_COUNT = "(length(text) - length(regexp_replace(text, '{}', '', 'g')))::bigint"

QUERIES = {
    "x01_bm25_char4": _run("char4"),
    "x01_bm25_char4_exact": _run("char4", exact=True),
    "x03_bm25_word": _run("word"),
    "x03_bm25_char2": _run("char2"),
    "x03_bm25_char3": _run("char3"),
    "x03_bm25_char5": _run("char5"),
} | {q.__name__: q for q in (j04_scored, x02_padded, f01_normalise, f01_normalise_exact, f02_categories, f03_words, f04_char4, a04_lengths, a05_idf, r05_synthetic, r06_known_items, x07_cosine, f08_unit_vectors, f08_masked_mean, f09_dot, x04_encode, x05_shards, x06_remaining, x08_token_length)}

_SHARDED = f"with {C.CTES}, own as (select lang, qid, length(text)::bigint n_chars, (row_number() over (partition by lang order by length(text), qid) - 1) // 4 as shard from topics)"
SQL = {
    "x01_bm25_char4": _run_sql("char4"),
    "j04_scored": _run_sql("word", False),
    "x02_padded": _run_sql("word"),
    "x03_bm25_word": _run_sql("word"),
    "x03_bm25_char2": _run_sql("char2"),
    "x03_bm25_char3": _run_sql("char3"),
    "x03_bm25_char5": _run_sql("char5"),
    "f01_normalise": f"{_TOPIC} select lang, qid, norm from topic",
    "f02_categories": f"with {C.CTES} select lang, qid, " + ", ".join(f"{_COUNT.format(p)} as {n}" for n, p in (("n_letters", r"\p{L}"), ("n_marks", r"\p{M}"), ("n_digits", r"\p{N}"), ("n_writing", r"[\p{P}\p{S}]"))) + " from topics",
    "f03_words": f"{_TOPIC} select lang, qid, {X.words_sql('norm')} as tokens from topic",
    "f04_char4": f"{_TOPIC} select lang, qid, {X.char_grams_sql('norm', 4)} as tokens from topic",
    "a04_lengths": f"with {bm25_sql('char4')} select lang, n_docs, round(mean_length, 6) as mean_length from stats",
    "a05_idf": f"with {bm25_sql('word')} select lang, term, df, round(idf, 6) as idf from idf join freq using (lang, term)",
    "r05_synthetic": f"select i as doc_id, array_to_string(list_transform(range(1, 91), lambda j: 'tok' || (('0x' || substr(md5('{BENCH_SEED}:' || i || ':' || j), 1, 8))::bigint % 4000)), ' ') as text from range(1500) t(i)",
    "r06_known_items": f"with {C.CTES} select lang, docid, array_to_string({X.words_sql('text')}[1:8], ' ') as query from (select * from passages where trim(text, ' ') <> '' qualify row_number() over (partition by lang order by docid) <= 50)",
    "x07_cosine": f"""with v as (select vec_id, {_UNIT} u from embeddings)
      select qid, docid, score, rank from (select q.vec_id as qid, v.vec_id as docid, round(list_dot_product(q.u, v.u), 6) as score, row_number() over (partition by q.vec_id order by round(list_dot_product(q.u, v.u), 6) desc, v.vec_id) as rank
        from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0) where rank <= 100""",
    "f08_unit_vectors": f"select vec_id, round(list_dot_product({_UNIT}, {_UNIT}), 6) as square, round({_UNIT}[1], 6) as first from embeddings",
    "f09_dot": "with f as (select label, arg_min(embedding, vec_id) w from embeddings group by 1) select vec_id, round(list_dot_product(embedding::double[], w::double[]), 6) as similarity from embeddings join f using (label)",
    "f08_masked_mean": "select label, list(m order by i) as mean from (select label, i, round(sum(case when vec_id % 2 = 0 then v else 0 end) / greatest(count(*) filter (where vec_id % 2 = 0), 1e-9::double), 6) m from (select label, vec_id, unnest(embedding::double[]) v, unnest(range(len(embedding))) i from embeddings) group by label, i) group by label",
    "x05_shards": f"{_SHARDED} select * from own",
    "x06_remaining": f"{_SHARDED} select lang, qid from own where shard <> 0",
    "x08_token_length": f"{_TOPIC} select lang, qid, least(len({X.char_grams_sql('norm', 4)}), 256)::bigint as n_tokens from topic",
}
