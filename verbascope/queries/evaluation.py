"""Evaluation of rankings and of stored scores (survey groups V, A, W, J, P of the evaluation path)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import bm25, evaluation as V, failures as L
from ..sources import collection as C
from ..sources.tables import table
from . import retrieval

FIRST, SECOND = "bm25-char4", "dense-small"
ROUNDED = ["ndcg10", "recall100", "mrr10"]


def _evaluated(spark, d, tokeniser="char4"):
    own = V.evaluate(retrieval.run(spark, d, tokeniser), C.judgments(spark, d), C.topics(spark, d))
    return own.withColumns({c: rounded(c, 6) for c in ROUNDED})


def v06_evaluate(spark, d):
    """Every score of BM25 over runs of 4 characters, for every query."""
    return _evaluated(spark, d)


def v06_evaluate_word(spark, d):
    return _evaluated(spark, d, "word")


def a01_mean_scores(spark, d):
    """Mean scores of the stored evaluations by system and language."""
    return V.means(C.scores(spark, d), ["sys_name", "lang"])


def a01_bm25_means(spark, d):
    """Mean scores of BM25 by language, from documents and queries to the mean."""
    own = _evaluated(spark, d)
    return own.groupBy("lang").agg(F.count(F.lit(1)).alias("n_queries"), *(rounded(F.avg(c), 6).alias(c) for c in ROUNDED))


def w02_ideal(spark, d):
    return V.ideal(C.judgments(spark, d)).select("lang", "qid", "n_positives", rounded("idcg", 6).alias("idcg"))


def j06_judged_run(spark, d):
    """The run with its grades, 0 where nobody judged."""
    own = retrieval.run(spark, d).join(C.judgments(spark, d), ["lang", "qid", "docid"], "left")
    return own.select("lang", "qid", "docid", F.col("rank").cast("bigint").alias("rank"), F.coalesce("rel", F.lit(0)).alias("rel"), F.col("rel").isNotNull().alias("judged"))


def j07_hits(spark, d):
    """Positives among the first hundred, by query that has any."""
    own = retrieval.run(spark, d).join(C.judgments(spark, d).where("rel > 0"), ["lang", "qid", "docid"])
    return own.groupBy("lang", "qid").agg(F.countDistinct("docid").alias("n_hits"))


def k04_languages_by_miss(spark, d):
    """Languages by the share of queries that BM25 misses, highest first, with their place."""
    own = L.failure_rates(C.scores(spark, d).where(F.col("sys_name") == FIRST), ["lang"])
    order = bm25.Window.orderBy(F.desc("rate_total_miss"), "lang")
    return own.select("lang", "rate_total_miss").withColumn("place", F.row_number().over(order).cast("bigint"))


def v08_categories(spark, d):
    return L.with_category(C.scores(spark, d)).select("sys_name", "lang", "qid", "category")


def a08_failure_rates(spark, d):
    return L.failure_rates(C.scores(spark, d), ["sys_name", "lang"])


def _pairs(spark, d):
    return L.paired(C.scores(spark, d), FIRST, SECOND)


def j09_pairs(spark, d):
    return L.pair_coverage(C.scores(spark, d), FIRST, SECOND)


def u02_common_queries(spark, d):
    own = C.scores(spark, d)
    keys = lambda name: own.where(F.col("sys_name") == name).select("lang", "qid")
    return keys(FIRST).intersect(keys(SECOND))


def t01_differences(spark, d):
    return _pairs(spark, d).select("lang", "qid", rounded(F.col("b.ndcg10") - F.col("a.ndcg10"), 6).alias("diff"))


def a09_transitions(spark, d):
    return L.transitions(_pairs(spark, d))


def k05_largest_transitions(spark, d):
    order = bm25.Window.partitionBy("lang").orderBy(F.desc("n"), "from_cat", "to_cat")
    return L.transitions(_pairs(spark, d)).withColumn("place", F.row_number().over(order).cast("bigint"))


def v09_rescued(spark, d):
    return L.rescued_and_broken(L.transitions(_pairs(spark, d)))


def v10_exposure(spark, d):
    return L.exposure(_pairs(spark, d))


def a12_exposure_summary(spark, d):
    return L.exposure_summary(L.exposure(_pairs(spark, d)))


#: Official nDCG@10 of BM25 by language, of the collection's own baseline, for the languages for which it is on record.
PUBLISHED = {"yo": 0.406, "sw": 0.383, "bn": 0.508, "te": 0.494, "hi": 0.458, "th": 0.484, "id": 0.449, "ko": 0.453, "fa": 0.357}


def v11_against_published(spark, d):
    """Stored BM25 means against the official baseline, as a relative deviation; languages without an official value have no row."""
    known = spark.createDataFrame(list(PUBLISHED.items()), "lang string, published double")
    own = C.scores(spark, d).where(F.col("sys_name") == FIRST).groupBy("lang").agg(F.avg("ndcg10").alias("own"))
    return own.join(F.broadcast(known), "lang").select("lang", rounded("own", 6).alias("ndcg10"), "published", rounded((F.col("own") - F.col("published")) / F.col("published"), 6).alias("deviation"))


def _swept(spark, d, tokenisers):
    """(tokeniser, lang, qid, ndcg10) of BM25 by several tokenisers in one run, which ranks as deep as nDCG@10 looks."""
    every = lambda df: df.withColumn("lang", F.explode(F.array(*(F.concat_ws("/", F.lit(t), "lang") for t in tokenisers))))
    asked = every(retrieval.topics(spark, d))
    run = bm25.run_bm25(every(retrieval.corpus(spark, d)), asked, None, V.CUT)
    own = V.evaluate(run, every(C.judgments(spark, d)), asked)
    parts = F.split("lang", "/")
    return own.select(parts[0].alias("tokeniser"), parts[1].alias("lang"), "qid", rounded("ndcg10", 6).alias("ndcg10"))


def a13_best_n(spark, d):
    """For each language, the mean nDCG@10 of every n, and which is best."""
    own = _swept(spark, d, [f"char{n}" for n in (2, 3, 4, 5)])
    parts = own.groupBy("lang", F.substring("tokeniser", 5, 1).cast("bigint").alias("n")).agg(rounded(F.avg("ndcg10"), 6).alias("ndcg10"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("ndcg10")).alias("by"), "n", "ndcg10")))  # four rows a language
    return parts.groupBy("lang").agg(ordered.alias("all")).select("lang", F.col("all")[0]["n"].alias("best_n"), F.inline(F.transform("all", lambda x: F.struct(x["n"].alias("n"), x["ndcg10"].alias("ndcg10"))))).select("lang", "n", "ndcg10", "best_n")


def a14_gain_over_words(spark, d):
    """Mean gain in nDCG@10 of runs of 4 characters over words, and on how many queries."""
    of = lambda name: F.max(F.when(F.col("tokeniser") == name, F.col("ndcg10")))
    diff = F.col("c") - F.col("w")
    own = _swept(spark, d, ["char4", "word"]).groupBy("lang", "qid").agg(of("char4").alias("c"), of("word").alias("w"))
    return own.groupBy("lang").agg(rounded(F.avg(diff), 6).alias("gain"), F.count_if(diff > 0).alias("n_better"), F.count_if(diff < 0).alias("n_worse"))


def pr06_positives(spark, d):
    return C.judgments(spark, d).where("rel > 0").select("lang", "qid", "docid", "rel")


def a06_survey(spark, d):
    """Queries, judgments and positives of each language, and ratios."""
    own = C.judgments(spark, d).groupBy("lang").agg(F.countDistinct("qid").alias("n_queries"), F.count(F.lit(1)).alias("n_judgments"), F.count_if(F.col("rel") > 0).alias("n_positives"))
    return own.select("*", rounded(F.col("n_judgments") / F.col("n_queries"), 2).alias("judgments_per_query"), rounded(F.col("n_positives") / F.col("n_queries"), 2).alias("positives_per_query"))


def a07_survey_summary(spark, d):
    """Published sizes over the languages that state one."""
    own = table(spark, d, "resource_proxy").where("mb > 0 and not isnan(mb)")
    return own.agg(F.count(F.lit(1)).alias("n_languages"), F.min("mb").alias("min_mb"), F.max("mb").alias("max_mb"), rounded(F.sum("mb") / 1024, 3).alias("total_gb"))


def a11_judged_share(spark, d):
    """Positives over judgments of each query, null where nothing is judged."""
    own = C.topics(spark, d).select("lang", "qid").join(C.judgments(spark, d), ["lang", "qid"], "left").groupBy("lang", "qid").agg(F.count("rel").alias("n_judged"), F.count_if(F.col("rel") > 0).alias("n_positive"))
    return own.select("lang", "qid", "n_judged", rounded(F.try_divide("n_positive", "n_judged"), 6).alias("share"))


def j08_unevaluated(spark, d):
    """Topics without any stored score, by language."""
    own = C.topics(spark, d).select("lang", "qid").join(C.scores(spark, d).select("lang", "qid", "sys_name"), ["lang", "qid"], "left")
    return own.groupBy("lang").agg(F.countDistinct("qid").alias("n_topics"), F.countDistinct(F.when(F.col("sys_name").isNull(), F.col("qid"))).alias("n_unevaluated"))


def w01_ranks(spark, d):
    """The first hundred of BM25 over all passages of the language, for every query."""
    return retrieval.run(spark, d).select("lang", "qid", "docid", F.col("rank").cast("bigint").alias("rank"))


def v01_dcg(spark, d):
    """The discounted gain of the first ten of BM25 over all passages, where there is any."""
    own = retrieval.run(spark, d).where("rank <= 10").join(C.judgments(spark, d).where("rel > 0"), ["lang", "qid", "docid"])
    return own.groupBy("lang", "qid").agg(rounded(F.sum(V.discounted(F.col("rel"), F.col("rank"))), 6).alias("dcg"))


def v02_ndcg(spark, d):
    return _evaluated(spark, d).select("lang", "qid", "ndcg10")


def v03_recall(spark, d):
    return _evaluated(spark, d).select("lang", "qid", "recall100", "n_positives")


def v04_mrr(spark, d):
    return _evaluated(spark, d).select("lang", "qid", "mrr10")


def v05_unjudged(spark, d):
    return _evaluated(spark, d).select("lang", "qid", "unjudged10", "unjudged100")


def w03_first_relevant(spark, d):
    """The rank of the first relevant passage among the first hundred of BM25, where there is one."""
    own = retrieval.run(spark, d).join(C.judgments(spark, d).where("rel > 0"), ["lang", "qid", "docid"])
    return own.groupBy("lang", "qid").agg(F.min("rank").cast("bigint").alias("first"))


def a18_score_spread(spark, d):
    """Best of, median and quartiles of nDCG@10 by system."""
    own = C.scores(spark, d).where("ndcg10 is not null").groupBy("sys_name").agg(F.max("ndcg10").alias("best"), F.percentile("ndcg10", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return own.select("sys_name", rounded("best", 6).alias("best"), *(rounded(F.col("q")[i], 6).alias(n) for i, n in enumerate(("lower", "median", "upper"))))


def pr12_keys(spark, d):
    """A name for each comparison of a dense system with a lexical one in a metric, that no other has."""
    own = C.scores(spark, d).select("sys_name").distinct()
    lexical, dense_ones = own.where("sys_name like 'bm25%'").select(F.col("sys_name").alias("reference")), own.where("sys_name like 'dense%'")
    joined = dense_ones.withColumn("kind", F.lit(1)).join(lexical.withColumn("kind", F.lit(1)), "kind")
    return joined.select("sys_name", "reference", F.explode(F.array(*map(F.lit, ROUNDED))).alias("metric")).select("sys_name", "reference", "metric", F.concat_ws("__", "sys_name", "reference", "metric").alias("key"))


def pr13_rounded(spark, d):
    """Stored scores to the places in which they are reported."""
    return C.scores(spark, d).select("sys_name", "lang", "qid", rounded("ndcg10", 4).alias("ndcg10"), rounded(F.col("unjudged10").cast("double"), 3).alias("unjudged10"))


def f19_percent(spark, d):
    """Differences in nDCG@10 as signed per cent."""
    diff = rounded(100 * (F.col("b.ndcg10") - F.col("a.ndcg10")), 1)
    return _pairs(spark, d).where("a.ndcg10 is not null and b.ndcg10 is not null").select("lang", "qid", F.concat(F.when(diff < 0, F.lit("-")).otherwise(F.lit("+")), F.format_string("%.1f", F.abs(diff)), F.lit("%")).alias("shown"))


_Q = (w01_ranks, w03_first_relevant, v01_dcg, v02_ndcg, v03_recall, v04_mrr, v05_unjudged, a18_score_spread, pr12_keys, pr13_rounded, f19_percent, v06_evaluate, v06_evaluate_word, a01_mean_scores, a01_bm25_means, w02_ideal, j06_judged_run, j07_hits, k04_languages_by_miss, v08_categories, a08_failure_rates, j09_pairs, u02_common_queries, t01_differences, a09_transitions, k05_largest_transitions, v09_rescued, v10_exposure, a12_exposure_summary, v11_against_published, a13_best_n, a14_gain_over_words, pr06_positives, a06_survey, a07_survey_summary, a11_judged_share, j08_unevaluated)
QUERIES = {q.__name__: q for q in _Q}

_IDEAL = "ideal as (select lang, qid, count(*) n_positives, sum(case when place <= 10 then rel / log2(place + 1) end) idcg from (select *, row_number() over (partition by lang, qid order by rel desc, docid) place from judgments where rel > 0) group by all)"
_EVALUATED = f"""{_IDEAL},
  found as (select lang, qid, sum(case when rel > 0 and rank <= 10 then rel / log2(rank + 1) end) dcg, count(*) filter (where rel > 0) hits,
      min(case when rel > 0 and rank <= 10 then rank end) best, count(*) filter (where rel is null and rank <= 10) unjudged10, count(*) filter (where rel is null) unjudged100
    from run left join judgments using (lang, qid, docid) group by all),
  evaluated as (select lang, qid, round(coalesce(dcg / nullif(idcg, 0), 0), 6) as ndcg10, round(coalesce(hits / n_positives, 0), 6) as recall100, round(coalesce(1 / best, 0), 6) as mrr10,
      coalesce(n_positives, 0) as n_positives, coalesce(unjudged10, 0) as unjudged10, coalesce(unjudged100, 0) as unjudged100
    from topics left join found using (lang, qid) left join ideal using (lang, qid))"""
_CAT = "case when coalesce({0}recall100, 0) = 0 then 'total_miss' when coalesce({0}ndcg10, 0) = 0 then 'deep_miss' when coalesce({0}mrr10, 0) < 1 then 'weak_rank' else 'rank1' end"
_MEANS = "round(avg(ndcg10), 4) as ndcg10, round(avg(recall100), 4) as recall100, round(avg(mrr10), 4) as mrr10, round(avg(unjudged10), 3) as unjudged10, round(avg(unjudged100), 2) as unjudged100"
_RATES = "count(*) as n, " + ", ".join(f"count(*) filter (where category = '{c}') as n_{c}, round(count(*) filter (where category = '{c}') / count(*), 4) as rate_{c}" for c in L.CATEGORIES)
_CATS = f"with {C.CTES}, cats as (select *, {_CAT.format('')} as category from scores)"
_PAIRS = f"with {C.CTES}, a as (select * from scores where sys_name = '{FIRST}'), b as (select * from scores where sys_name = '{SECOND}')"
_MOVES = f"{_PAIRS}, moves as (select lang, {_CAT.format('a.')} as from_cat, {_CAT.format('b.')} as to_cat, count(*) as n from a join b using (lang, qid) group by all)"
_EXPOSURE = f"{_PAIRS}, exposure as (select lang, count(*) as n, round(avg(a.unjudged10), 3) as first_unjudged10, round(avg(b.unjudged10), 3) as second_unjudged10, round(avg(b.unjudged10 - a.unjudged10), 3) as difference from a join b using (lang, qid) where a.unjudged10 is not null and b.unjudged10 is not null group by all)"
_MISS = "('total_miss', 'deep_miss')"


_BM25 = f"with {retrieval.bm25_sql('char4')}, {_EVALUATED}"

SQL = {
    "w01_ranks": f"{_BM25} select lang, qid, docid, rank from run",
    "w03_first_relevant": f"{_BM25} select lang, qid, min(rank) as first from run join judgments using (lang, qid, docid) where rel > 0 group by all",
    "v01_dcg": f"{_BM25} select lang, qid, round(dcg, 6) as dcg from found where dcg is not null",
    "v02_ndcg": f"{_BM25} select lang, qid, ndcg10 from evaluated",
    "v03_recall": f"{_BM25} select lang, qid, recall100, n_positives from evaluated",
    "v04_mrr": f"{_BM25} select lang, qid, mrr10 from evaluated",
    "v05_unjudged": f"{_BM25} select lang, qid, unjudged10, unjudged100 from evaluated",
    "a18_score_spread": f"with {C.CTES} select sys_name, round(max(ndcg10), 6) as best, round(quantile_cont(ndcg10, 0.25), 6) as lower, round(quantile_cont(ndcg10, 0.5), 6) as median, round(quantile_cont(ndcg10, 0.75), 6) as upper from scores where ndcg10 is not null group by 1",
    "pr12_keys": f"with {C.CTES}, own as (select distinct sys_name from scores) select a.sys_name, b.sys_name as reference, metric, a.sys_name || '__' || b.sys_name || '__' || metric as key from own a, own b, (values ('ndcg10'), ('recall100'), ('mrr10')) m(metric) where a.sys_name like 'dense%' and b.sys_name like 'bm25%'",
    "pr13_rounded": f"with {C.CTES} select sys_name, lang, qid, round(ndcg10, 4) as ndcg10, round(unjudged10::double, 3) as unjudged10 from scores",
    "f19_percent": f"{_PAIRS} select lang, qid, case when round(100 * (b.ndcg10 - a.ndcg10), 1) < 0 then '-' else '+' end || printf('%.1f', abs(round(100 * (b.ndcg10 - a.ndcg10), 1))) || '%' as shown from a join b using (lang, qid) where a.ndcg10 is not null and b.ndcg10 is not null",
    "v06_evaluate": f"with {retrieval.bm25_sql('char4')}, {_EVALUATED} select * from evaluated",
    "v06_evaluate_word": f"with {retrieval.bm25_sql('word')}, {_EVALUATED} select * from evaluated",
    "a01_mean_scores": f"with {C.CTES} select sys_name, lang, count(*) as n_queries, {_MEANS} from scores group by all",
    "a01_bm25_means": f"with {retrieval.bm25_sql('char4')}, {_EVALUATED} select lang, count(*) as n_queries, round(avg(ndcg10), 6) as ndcg10, round(avg(recall100), 6) as recall100, round(avg(mrr10), 6) as mrr10 from evaluated group by 1",
    "w02_ideal": f"with {C.CTES}, {_IDEAL} select lang, qid, n_positives, round(idcg, 6) as idcg from ideal",
    "j06_judged_run": f"with {retrieval.bm25_sql('char4')} select lang, qid, docid, rank, coalesce(rel, 0) as rel, rel is not null as judged from run left join judgments using (lang, qid, docid)",
    "j07_hits": f"with {retrieval.bm25_sql('char4')} select lang, qid, count(distinct docid) as n_hits from run join judgments using (lang, qid, docid) where rel > 0 group by all",
    "k04_languages_by_miss": f"{_CATS}, r as (select lang, {_RATES} from cats where sys_name = '{FIRST}' group by 1) select lang, rate_total_miss, row_number() over (order by rate_total_miss desc, lang) as place from r",
    "v08_categories": f"{_CATS} select sys_name, lang, qid, category from cats",
    "a08_failure_rates": f"{_CATS} select sys_name, lang, {_RATES} from cats group by all",
    "j09_pairs": f"{_PAIRS} select coalesce(a.lang, b.lang) as lang, count(*) filter (where a.qid is not null and b.qid is not null) as n_both, count(*) filter (where b.qid is null) as n_first_only, count(*) filter (where a.qid is null) as n_second_only from a full join b on a.lang = b.lang and a.qid = b.qid group by 1",
    "u02_common_queries": f"{_PAIRS} select lang, qid from a intersect select lang, qid from b",
    "t01_differences": f"{_PAIRS} select lang, qid, round(b.ndcg10 - a.ndcg10, 6) as diff from a join b using (lang, qid)",
    "a09_transitions": f"{_MOVES} select * from moves",
    "k05_largest_transitions": f"{_MOVES} select *, row_number() over (partition by lang order by n desc, from_cat, to_cat) as place from moves",
    "v09_rescued": f"""{_MOVES}, s as (select lang, sum(n)::bigint n, coalesce(sum(n) filter (where from_cat in {_MISS} and to_cat not in {_MISS}), 0)::bigint r, coalesce(sum(n) filter (where from_cat not in {_MISS} and to_cat in {_MISS}), 0)::bigint b from moves group by 1)
      select lang, n, r as n_rescued, b as n_broken, round(r / n, 4) as rescued_rate, round(b / n, 4) as broken_rate, round((r - b) / n, 4) as net_rate from s""",
    "v10_exposure": f"{_EXPOSURE} select * from exposure",
    "a12_exposure_summary": f"{_EXPOSURE} select count(*) as k, round(avg(difference), 4) as mean_difference, min(difference) as min_difference, max(difference) as max_difference, count(*) filter (where difference > 0) as n_second_higher from exposure",
    "v11_against_published": f"with {C.CTES}, known(lang, published) as (values {', '.join(f'({k!r}, {v}::double)' for k, v in PUBLISHED.items())}), own as (select lang, avg(ndcg10) m from scores where sys_name = '{FIRST}' group by 1) select lang, round(m, 6) as ndcg10, published, round((m - published) / published, 6) as deviation from own join known using (lang)",
    "a13_best_n": f"""with {retrieval.sweep_sql()}, {_EVALUATED}, p as (select split_part(lang, '/', 2) lang, split_part(lang, '/', 1)::bigint as n, round(avg(ndcg10), 6) as ndcg10 from evaluated group by all), best as (select lang, n as best_n from p qualify row_number() over (partition by lang order by ndcg10 desc, n) = 1)
      select lang, n, ndcg10, best_n from p join best using (lang)""",
    "a14_gain_over_words": f"""with c as (select * from (with {retrieval.bm25_sql('char4')}, {_EVALUATED} select lang, qid, ndcg10 from evaluated)), w as (select * from (with {retrieval.bm25_sql('word')}, {_EVALUATED} select lang, qid, ndcg10 from evaluated))
      select lang, round(avg(c.ndcg10 - w.ndcg10), 6) as gain, count(*) filter (where c.ndcg10 > w.ndcg10) as n_better, count(*) filter (where c.ndcg10 < w.ndcg10) as n_worse from c join w using (lang, qid) group by 1""",
    "pr06_positives": f"with {C.CTES} select lang, qid, docid, rel from judgments where rel > 0",
    "a06_survey": f"with {C.CTES}, s as (select lang, count(distinct qid) as n_queries, count(*) as n_judgments, count(*) filter (where rel > 0) as n_positives from judgments group by 1) select *, round(n_judgments / n_queries, 2) as judgments_per_query, round(n_positives / n_queries, 2) as positives_per_query from s",
    "a07_survey_summary": "select count(*) as n_languages, min(mb) as min_mb, max(mb) as max_mb, round(sum(mb) / 1024, 3) as total_gb from resource_proxy where mb > 0 and not isnan(mb)",
    "a11_judged_share": f"with {C.CTES} select lang, qid, count(rel) as n_judged, round(count(*) filter (where rel > 0) / nullif(count(rel), 0), 6) as share from topics left join judgments using (lang, qid) group by all",
    "j08_unevaluated": f"with {C.CTES} select lang, count(distinct qid) as n_topics, count(distinct case when sys_name is null then qid end) as n_unevaluated from topics left join (select lang, qid, sys_name from scores) s using (lang, qid) group by 1",
}
