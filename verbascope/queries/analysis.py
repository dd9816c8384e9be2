"""Statistics over stored scores, covariates, tokeniser statistics and report tables (survey groups T, W04, Z, P, G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import rounded
from ..operators import failures as L
from ..operators import fertility as Z
from ..operators import statistics as S
from ..plans.materialise import materialise
from ..sources import collection as C
from ..sources.tables import table
from .evaluation import FIRST, SECOND

RESAMPLES, SEED = 10_000, 20250317
#: Names under which the experiments of words and runs of 4, and of other lengths, are stored.
EXPERIMENT, SWEEP = "EXP-004", "EXP-013"
#: Languages left out of each pooled subset.
SUBSETS = {"all": (), "without zh": ("zh",), "without zh, ko, ja": ("zh", "ko", "ja")}
#: The registry of encoders: key, prefixes, tokeniser family, declared languages, languages it lacks (null: not known), task.
ENCODERS = [
    ("E5", "query: ", "passage: ", "XLM-R-250k", 94, ["yo"], "retrieval"),
    ("E5base", "query: ", "passage: ", "XLM-R-250k", 94, ["yo"], "retrieval"),
    ("BGEM3", "", "", "XLM-R-250k", None, None, "retrieval"),
    ("LaBSE", "", "", "LaBSE-501k", 110, [], "bitext/similarity"),
    ("A", "", "", "XLM-R-250k", 50, ["yo", "sw", "te", "bn", "zh"], "paraphrase/STS"),
    ("B", "", "", "mBERT-119k", 50, ["yo", "sw", "te", "bn", "zh"], "paraphrase/STS"),
]
#: Vocabulary sizes of encoders by task.
VOCABULARIES = [("retrieval", 250002), ("retrieval", 250048), ("retrieval", 250037), ("bitext/similarity", 501153), ("paraphrase/STS", 250037), ("paraphrase/STS", 119547)]


def with_encoders(df, *keys):
    """Every row of `df` beside the registry entries of these keys; all of them if none is named."""
    lacking = lambda x: F.lit(None).cast("array<string>") if x is None else F.array(*map(F.lit, x)).cast("array<string>")
    rows = [F.struct(F.lit(key).alias("key"), F.lit(query).alias("query_prefix"), lacking(missing).alias("missing")) for key, query, _, _, _, missing, _ in ENCODERS if not keys or key in keys]
    return df.select("*", F.inline(F.array(*rows)))


def _pairs(spark, d):
    return L.paired(C.scores(spark, d), FIRST, SECOND)


def _differences(spark, d):
    return _pairs(spark, d).select("lang", "qid", rounded(F.col("b.ndcg10") - F.col("a.ndcg10"), 6).alias("diff")).where("diff is not null")


def _bootstrap(spark, d):
    """The paired bootstrap of each language with at least two pairs."""
    own = _differences(spark, d)
    many = own.groupBy("lang").agg(F.count("diff").alias("n")).where("n > 1").select("lang")
    return S.paired_bootstrap(own.join(many, "lang", "left_semi"), ["lang"], ["qid"], RESAMPLES, SEED)


def _effects(spark, d):
    """(lang, y, se): mean difference and the standard error of its bootstrap; a row a language, computed once."""
    return materialise(_bootstrap(spark, d).select("lang", F.col("mean_diff").alias("y"), F.col("boot_se").alias("se"), "ci95_low", "ci95_high"))


def _subsets(effects):
    kept = [F.when(~F.col("lang").isin(*out) if out else F.lit(True), F.lit(name)) for name, out in SUBSETS.items()]
    return effects.withColumn("subset", F.explode(F.array_compact(F.array(*kept))))


def t02_bootstrap(spark, d):
    return _bootstrap(spark, d)


def t03_variances(spark, d):
    return _effects(spark, d).select("lang", rounded(F.greatest(F.col("se") * F.col("se"), F.lit(S.LEAST_VARIANCE)), 6).alias("variance"))


def t04_random_effects(spark, d):
    return S.random_effects(_effects(spark, d).withColumn("comparison", F.lit(f"{SECOND} - {FIRST}")), ["comparison"])


def t05_robustness(spark, d):
    return S.random_effects(_subsets(_effects(spark, d)), ["subset"])


def pr08_subsets(spark, d):
    return _subsets(_effects(spark, d)).groupBy("subset").agg(F.count(F.lit(1)).alias("k"))


def _resource(spark, d):
    return table(spark, d, "resource_proxy").select("lang", "published", F.when(~F.isnan("mb") & (F.col("mb") > 0), F.col("mb")).alias("mb"))


def _covariates(spark, d):
    """(lang, ndcg, unjudged, mb, per_char): one row a language."""
    own = C.scores(spark, d).where(F.col("sys_name") == FIRST).groupBy("lang").agg(rounded(F.avg("ndcg10"), 6).alias("ndcg"), rounded(F.avg("unjudged10"), 6).alias("unjudged"))
    split = Z.measure(C.topics(spark, d), ["lang"], "text").where("family = 'byte3'").select("lang", F.col("tokens_per_char").alias("per_char"))
    return own.join(_resource(spark, d).select("lang", "mb"), "lang").join(split, "lang")


def w04_ranks(spark, d):
    own = _covariates(spark, d).where("mb is not null")
    return own.select("lang", "mb", S.average_rank("mb", []).alias("rank"))


def t06_spearman(spark, d):
    own = S.rank_correlations(_covariates(spark, d), [], ["ndcg", "unjudged", "mb", "per_char"])
    return own.select("n", *(rounded(c, 6).alias(c) for c in own.columns if c != "n"))


def _correlations(spark, d):
    return S.rank_correlations(_covariates(spark, d), [], ["ndcg", "mb", "per_char"])


def t07_partial(spark, d):
    """The correlation of nDCG with size given tokens per character, and the other way."""
    x, y, z = F.col("rho_ndcg_mb"), F.col("rho_ndcg_per_char"), F.col("rho_mb_per_char")
    return _correlations(spark, d).select("n", rounded(S.partial(x, y, z), 6).alias("ndcg_mb_given_per_char"), rounded(S.partial(y, x, z), 6).alias("ndcg_per_char_given_mb"))


def t08_fisher(spark, d):
    low, high = S.fisher_interval(F.col("rho_ndcg_mb"), F.col("n"))
    return _correlations(spark, d).select("n", rounded("rho_ndcg_mb", 6).alias("rho"), rounded(low, 6).alias("low"), rounded(high, 6).alias("high"))


def t09_collinearity(spark, d):
    r = F.col("rho_mb_per_char")
    return _correlations(spark, d).select("n", rounded(r, 6).alias("rho"), rounded(F.try_divide(F.lit(1.0), 1 - r * r), 6).alias("vif"))


def t10_detectable(spark, d):
    own = spark.range(4, 31).select(F.col("id").alias("n"))
    return own.select("n", rounded(S.detectable(F.col("n")), 6).alias("rho"))


def t11_projection(spark, d):
    """Hours to encode each language's passages at 9.47 a second."""
    return C.passages(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs")).select("lang", "n_docs", rounded(F.col("n_docs") / 9.47 / 3600, 6).alias("hours"))


def f20_sizes(spark, d):
    own = table(spark, d, "resource_proxy")
    return own.select("lang", "published", X.size_in_mb(F.col("published")).alias("mb"))


def f07_log_sizes(spark, d):
    return _resource(spark, d).where("mb is not null").select("lang", rounded(F.log10("mb"), 6).alias("log10_mb"))


def a19_extremes(spark, d):
    own = _resource(spark, d).where("mb is not null")
    return own.agg(F.max("mb").alias("max_mb"), F.min("mb").alias("min_mb"), F.max_by("lang", F.struct("mb", "lang")).alias("largest"), F.min_by("lang", F.struct("mb", "lang")).alias("smallest"), rounded(F.max("mb") / F.min("mb"), 3).alias("spread"))


def a20_vocabularies(spark, d):
    own = spark.createDataFrame(VOCABULARIES, "task string, size int")
    return own.groupBy("task").agg(F.array_sort(F.collect_set("size")).alias("sizes"), F.count(F.lit(1)).alias("n_models"))


def _languages(spark, d):
    return table(spark, d, "resource_proxy").select("lang").distinct()


def pr07_coverage(spark, d):
    """Whether each encoder covers each language: true, false, or null where its languages are not known."""
    return with_encoders(_languages(spark, d)).select("lang", "key", (~F.array_contains("missing", F.col("lang"))).alias("declares_support"))


def v07_flagged(spark, d):
    """Mean nDCG@10 of the dense system by language, with the coverage that each encoder would declare."""
    own = C.scores(spark, d).where(F.col("sys_name") == SECOND).groupBy("lang").agg(rounded(F.avg("ndcg10"), 6).alias("ndcg10"))
    support = ~F.array_contains("missing", F.col("lang"))
    return with_encoders(own).select("lang", "key", "ndcg10", support.alias("declares_support"), (~support).alias("coverage_confounded"))


def pr09_unsegmented(spark, d):
    return _languages(spark, d).select("lang", F.col("lang").isin(*X.UNSEGMENTED).alias("unsegmented"), F.when(F.col("lang").isin(*X.UNSEGMENTED), "words are not between blanks").alias("warning"))


def pr10_prefixes(spark, d):
    """Each query as each encoder sees it, with its prefix or without one."""
    return with_encoders(C.topics(spark, d)).select("lang", "qid", "key", F.concat("query_prefix", "text").alias("input"), (F.col("query_prefix") != "").alias("changed"))


def pr11_experiments(spark, d):
    """Names of the lexical experiments by configuration."""
    own = spark.createDataFrame([("word", None), ("char", 2), ("char", 3), ("char", 4), ("char", 5)], "tok string, n int")
    return own.select("tok", "n", F.when((F.col("tok") == "word") | (F.col("n") == 4), F.concat(F.lit(f"{EXPERIMENT}-bm25-"), "tok")).otherwise(F.concat(F.lit(f"{SWEEP}-bm25-"), "tok", F.lit("-n"), F.col("n").cast("string"))).alias("experiment"))


def _passage_texts(spark, d):
    return C.passages(spark, d).select("lang", X.passage_text(F.col("title"), F.col("text")).alias("text"))


def z01_fertility(spark, d):
    """How four public vocabularies split the words of all passages, by language."""
    return Z.measure_subwords(_passage_texts(spark, d), ["lang"], "text")


def z01_lengths(spark, d):
    """The same by families of word length alone."""
    return Z.measure(_passage_texts(spark, d), ["lang"], "text")


def z01_subwords(spark, d):
    """Subwords of every query by each vocabulary."""
    return Z.measure_subwords(C.topics(spark, d), ["lang", "qid"], "text").select("lang", "qid", "family", "n_words", "n_chars", "n_tokens")


def z02_ratios(spark, d):
    return Z.measure_subwords(C.topics(spark, d), ["lang"], "text").select("lang", "family", "fertility", "single_rate", "tokens_per_char")


def z02_length_ratios(spark, d):
    return Z.measure(C.topics(spark, d), ["lang"], "text").select("lang", "family", "fertility", "single_rate", "tokens_per_char")


def z03_validity(spark, d):
    """Fertility of the queries, and whether it says anything: words of some languages are not between blanks."""
    return Z.measure_subwords(C.topics(spark, d), ["lang"], "text").select("lang", "family", "fertility", Z.word_measure_valid(F.col("lang")).alias("word_measure_valid"))


def z03_length_validity(spark, d):
    return Z.measure(C.topics(spark, d), ["lang"], "text").where("family = 'char4'").select("lang", "fertility", Z.word_measure_valid(F.col("lang")).alias("word_measure_valid"))


def _outcomes(spark, d):
    zero = lambda x, c: F.coalesce(F.col(f"{x}.{c}"), F.lit(0.0))
    miss = lambda x: L.category(zero(x, "ndcg10"), zero(x, "recall100"), zero(x, "mrr10")).isin(*L.MISSES)
    outcome = F.when(miss("a") & miss("b"), "both_miss").when(miss("a"), "rescued").when(miss("b"), "broken").otherwise("both_hit")
    return _pairs(spark, d).select("lang", "qid", outcome.alias("outcome"), F.col("a.n_positives").alias("n_positives"))


def a15_outcome_profile(spark, d):
    own = C.topics(spark, d)
    return Z.outcome_profile(_outcomes(spark, d), own, Z.per_word_by_length(own)).drop("mean_tokens_per_word")


def z04_query_fertility(spark, d):
    """Tokens a word, by the byte-level vocabulary of many languages, of queries by outcome."""
    own = C.topics(spark, d)
    split = Z.measure_subwords(own, ["lang", "qid"], "text", ("byte_bpe_multi_50k",)).select("lang", "qid", (F.col("n_tokens") / F.col("n_words")).alias("per_word"))
    return Z.outcome_profile(_outcomes(spark, d), own, split).select("lang", "outcome", "mean_tokens_per_word")


def z04_query_lengths(spark, d):
    own = C.topics(spark, d)
    return Z.outcome_profile(_outcomes(spark, d), own, Z.per_word_by_length(own)).select("lang", "outcome", "mean_tokens_per_word")


def g01_report(spark, d):
    """Each language's two means, their difference and the interval of its bootstrap, with the size as text."""
    own = _pairs(spark, d).where("a.ndcg10 is not null and b.ndcg10 is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("a.ndcg10").alias("first"), F.avg("b.ndcg10").alias("second"), F.avg(F.col("b.ndcg10") - F.col("a.ndcg10")).alias("diff"))
    r = lambda x: rounded(x, 4)
    known = own.join(_effects(spark, d).select("lang", "ci95_low", "ci95_high"), "lang", "left").join(_resource(spark, d).select("lang", "published"), "lang", "left")
    return known.select("lang", "n", r("first").alias("first"), r("second").alias("second"), r("diff").alias("diff"), r("ci95_low").alias("low"), r("ci95_high").alias("high"), "published", rounded(100 * F.col("diff"), 1).alias("diff_percent"))


def g02_scatter(spark, d):
    """What figure 1 shows: log10 of the size against the difference, with intervals and coverage."""
    support = ~F.array_contains("missing", F.col("lang"))
    sized = g01_report(spark, d).join(_resource(spark, d).where("mb is not null").select("lang", "mb"), "lang")
    return with_encoders(sized).select("lang", "key", rounded(F.log10("mb"), 6).alias("log10_mb"), "diff", "low", "high", support.alias("supported"))


def g03_stacked(spark, d):
    """What figure 2 shows: rates of outcomes by system and language, in order of the lexical system's misses."""
    own = L.failure_rates(C.scores(spark, d).where(F.col("sys_name").isin(FIRST, SECOND)), ["sys_name", "lang"])
    first = own.where(F.col("sys_name") == FIRST).select("lang", F.row_number().over(Window.orderBy(F.desc("rate_total_miss"), "lang")).cast("bigint").alias("place"))
    return own.join(first, "lang").select("place", "lang", "sys_name", *(f"rate_{c}" for c in L.CATEGORIES))


def j10_joined(spark, d):
    """Every language's lexical and dense means, exposure and size in one row."""
    mean = lambda name: C.scores(spark, d).where(F.col("sys_name") == name).groupBy("lang").agg(rounded(F.avg("ndcg10"), 6).alias(name.replace("-", "_")))
    return mean(FIRST).join(mean(SECOND), "lang").join(L.exposure(_pairs(spark, d)).select("lang", "difference"), "lang").join(_resource(spark, d).select("lang", "mb"), "lang")


_Q = (t02_bootstrap, t03_variances, t04_random_effects, t05_robustness, pr07_coverage, pr08_subsets, pr09_unsegmented, pr10_prefixes, pr11_experiments, w04_ranks, t06_spearman, t07_partial, t08_fisher, t09_collinearity, t10_detectable, t11_projection, f20_sizes, f07_log_sizes, a19_extremes, a20_vocabularies, v07_flagged, z01_fertility, z01_lengths, z01_subwords, z02_ratios, z02_length_ratios, z03_validity, z03_length_validity, z04_query_fertility, z04_query_lengths, a15_outcome_profile, g01_report, g02_scatter, g03_stacked, j10_joined)
QUERIES = {q.__name__: q for q in _Q}

_CATEGORY = "case when coalesce({0}recall100, 0) = 0 then 'total_miss' when coalesce({0}ndcg10, 0) = 0 then 'deep_miss' when coalesce({0}mrr10, 0) < 1 then 'weak_rank' else 'rank1' end"
_PAIRS = f"with {C.CTES}, a as (select * from scores where sys_name = '{FIRST}'), b as (select * from scores where sys_name = '{SECOND}'), diffs as (select lang, qid, round(b.ndcg10 - a.ndcg10, 6) diff from a join b using (lang, qid) where b.ndcg10 - a.ndcg10 is not null)"
_UNITS = ", ".join(f"(('0x' || substr(h, {1 + 4 * j}, 4))::int) u{j}" for j in range(S.WEIGHTS_PER_HASH))
_WEIGHTS = ", ".join("(" + " + ".join(f"(u{j} >= {x})::bigint" for x in S.WEIGHT_STEPS) + f") w{j}" for j in range(S.WEIGHTS_PER_HASH))
_MEANS = " union all ".join(f"select lang, block * {S.WEIGHTS_PER_HASH} + {j} + 1 b, sum(w{j} * x) / 1e6::double / nullif(sum(w{j}), 0) mean from weighed group by lang, block" for j in range(S.WEIGHTS_PER_HASH))
_BOOT = f"""{_PAIRS}, sizes as (select lang, count(*) n, avg(diff) m from diffs group by 1 having count(*) > 1),
  hashed as (select lang, round_even(diff * 1e6::double, 0)::bigint x, block, md5('{SEED}:' || lang || ':' || qid || ':' || block) h from diffs semi join sizes using (lang), range({-(-RESAMPLES // S.WEIGHTS_PER_HASH)}) t(block)),
  weighed as materialized (select lang, x, block, {_WEIGHTS} from (select lang, x, block, {_UNITS} from hashed)), means as ({_MEANS}),
  ci as (select lang, round(quantile_cont(mean, 0.025), 6) lo, round(quantile_cont(mean, 0.975), 6) hi, round(stddev_samp(mean), 6) se from means where b <= {RESAMPLES} and mean is not null group by 1),
  boot as (select lang, n, round(m, 6) as mean_diff, lo as ci95_low, hi as ci95_high, se as boot_se, lo > 0 or hi < 0 as excludes_zero from sizes join ci using (lang))"""
_EFFECTS = f"{_BOOT}, effects as (select lang, mean_diff y, boot_se se from boot)"
_SUBSETS = f"{_EFFECTS}, parts as (" + " union all ".join(f"select '{name}' as subset, * from effects" + (f" where lang not in ({', '.join(map(repr, out))})" if out else "") for name, out in SUBSETS.items()) + ")"


def _pooled(source: str, by: str) -> str:
    return f"""w as (select {by}, y, greatest(se * se, 1e-12::double) v from {source}),
      f as (select {by}, count(*) k, sum(1 / v) sw, sum(1 / v / v) sw2, sum(y / v) / sum(1 / v) m from w group by all),
      q as (select {by}, k, sw - sw2 / sw c, sum(pow(y - m, 2) / v) q from w join f using ({by}) group by all),
      t as (select *, case when c > 0 then greatest(0, (q - (k - 1)) / c) else 0 end tau2 from q),
      p as (select {by}, k, q, tau2, sum(y / (v + tau2)) / sum(1 / (v + tau2)) m, sqrt(1 / sum(1 / (v + tau2))) s from w join t using ({by}) group by all)
      select {by}, k, round(m, 6) as pooled_effect, round(s, 6) as se, round(m - 1.96::double * s, 6) as ci95_low, round(m + 1.96::double * s, 6) as ci95_high, round(tau2, 6) as tau2, round(q, 6) as q, k - 1 as df,
        round(case when q > 0 then greatest(0, (q - (k - 1)) / q) else 0 end, 6) as i2 from p"""


def _measured(source: str, by: str, text: str) -> str:
    """(by, family, n_words, n_chars, n_tokens, fertility, single_rate, tokens_per_char) in SQL."""
    return f"""select {by}, family, count(*) as n_words, sum(chars)::bigint as n_chars, sum(tokens)::bigint as n_tokens, round(sum(tokens) / count(*), 4) as fertility, round(count(*) filter (where tokens = 1) / count(*), 4) as single_rate, round(sum(tokens) / sum(chars), 4) as tokens_per_char
      from (select {by}, family, length(word) chars, case family when 'char4' then greatest(length(word) - 3, 1) when 'byte3' then ceil(strlen(word) / 3)::bigint else 1 end tokens
        from (select {by}, unnest({X.words_sql(text)}) word from {source}), (values ('char4'), ('byte3'), ('whole')) f(family)) group by all"""


_RESOURCE = "resource as (select lang, published, case when not isnan(mb) and mb > 0 then mb end mb from resource_proxy)"
_COVARIATES = f"""with {C.CTES}, {_RESOURCE}, measured as ({_measured('topics', 'lang', 'text')}),
  covariates as (select lang, ndcg, unjudged, mb, tokens_per_char per_char from (select lang, round(avg(ndcg10), 6) ndcg, round(avg(unjudged10), 6) unjudged from scores where sys_name = '{FIRST}' group by 1) join resource using (lang) join (select * from measured where family = 'byte3') using (lang))"""


def _ranks(columns: list[str]) -> str:
    there = " and ".join(f"{c} is not null" for c in columns)
    return "ranks as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as {c}" for c in columns) + f" from covariates where {there})"


_THREE = f"{_COVARIATES}, {_ranks(['ndcg', 'mb', 'per_char'])}, rho as (select count(*) n, corr(ndcg, mb) x, corr(ndcg, per_char) y, corr(mb, per_char) z from ranks)"
_PARTIAL = "({0} - {1} * {2}) / sqrt((1 - {1} * {1}) * (1 - {2} * {2}))"
_FOUR = ["ndcg", "unjudged", "mb", "per_char"]
_ENCODERS = "encoders(key, query_prefix, missing) as (values " + ", ".join(f"('{k}', '{q}', {'null::varchar[]' if m is None else f'{m}::varchar[]'})" for k, q, _, _, _, m, _ in ENCODERS) + ")"
_MISS = "({0}) in ('total_miss', 'deep_miss')"
_A, _B = _MISS.format(_CATEGORY.format("a.")), _MISS.format(_CATEGORY.format("b."))
_PROFILE = f"""{_PAIRS}, outcomes as (select lang, qid, case when {_A} and {_B} then 'both_miss' when {_A} then 'rescued' when {_B} then 'broken' else 'both_hit' end as outcome, a.n_positives from a join b using (lang, qid)),
  shaped as (select lang, qid, len(w) n_words, length(text) n_chars, list_sum(list_transform(w, lambda x: greatest(length(x) - 3, 1))) / len(w) per_word from (select *, {X.words_sql('text')} w from topics))"""
_REPORT = f"""{_BOOT}, {_RESOURCE}, m as (select lang, count(*) as n, avg(a.ndcg10) f, avg(b.ndcg10) s, avg(b.ndcg10 - a.ndcg10) x from a join b using (lang, qid) where a.ndcg10 is not null and b.ndcg10 is not null group by 1),
  report as (select lang, m.n, round(f, 4) as first, round(s, 4) as second, round(x, 4) as diff, round(ci95_low, 4) as low, round(ci95_high, 4) as high, published, round(100 * x, 1) as diff_percent from m left join boot using (lang) left join resource using (lang))"""
_CATS = f"with {C.CTES}, cats as (select *, {_CATEGORY.format('')} as category from scores)"
_RATES = ", ".join(f"round(count(*) filter (where category = '{c}') / count(*), 4) as rate_{c}" for c in L.CATEGORIES)

SQL = {
    "t02_bootstrap": f"{_BOOT} select * from boot",
    "t03_variances": f"{_EFFECTS} select lang, round(greatest(se * se, 1e-12::double), 6) as variance from effects",
    "t04_random_effects": f"{_EFFECTS}, one as (select '{SECOND} - {FIRST}' as comparison, * from effects), {_pooled('one', 'comparison')}",
    "t05_robustness": f"{_SUBSETS}, {_pooled('parts', 'subset')}",
    "pr08_subsets": f"{_SUBSETS} select subset, count(*) as k from parts group by 1",
    "pr07_coverage": f"with {_ENCODERS} select lang, key, not list_contains(missing, lang) as declares_support from (select distinct lang from resource_proxy), encoders",
    "pr09_unsegmented": f"select distinct lang, lang in {X.UNSEGMENTED} as unsegmented, case when lang in {X.UNSEGMENTED} then 'words are not between blanks' end as warning from resource_proxy",
    "pr10_prefixes": f"with {C.CTES}, {_ENCODERS} select lang, qid, key, query_prefix || text as input, query_prefix <> '' as changed from topics, encoders",
    "pr11_experiments": f"select tok, n, case when tok = 'word' or n = 4 then '{EXPERIMENT}-bm25-' || tok else '{SWEEP}-bm25-' || tok || '-n' || n end as experiment from (values ('word', null::int), ('char', 2), ('char', 3), ('char', 4), ('char', 5)) t(tok, n)",
    "w04_ranks": f"{_COVARIATES} select lang, mb, rank() over (order by mb) + (count(*) over (partition by mb) - 1) / 2 as rank from covariates where mb is not null",
    "t06_spearman": f"{_COVARIATES}, {_ranks(_FOUR)} select count(*) as n, " + ", ".join(f"round(corr({x}, {y}), 6) as rho_{x}_{y}" for i, x in enumerate(_FOUR) for y in _FOUR[i + 1 :]) + " from ranks",
    "t07_partial": f"{_THREE} select n, round({_PARTIAL.format('x', 'y', 'z')}, 6) as ndcg_mb_given_per_char, round({_PARTIAL.format('y', 'x', 'z')}, 6) as ndcg_per_char_given_mb from rho",
    "t08_fisher": f"{_THREE} select n, round(x, 6) as rho, round(tanh(atanh(x) - 1.96::double / sqrt(n - 3)), 6) as low, round(tanh(atanh(x) + 1.96::double / sqrt(n - 3)), 6) as high from rho",
    "t09_collinearity": f"{_THREE} select n, round(z, 6) as rho, round(1 / (1 - z * z), 6) as vif from rho",
    "t10_detectable": "select n, round(tanh(1.96::double / sqrt(n - 3)), 6) as rho from range(4, 31) t(n)",
    "t11_projection": f"with {C.CTES} select lang, count(*) as n_docs, round(count(*) / 9.47::double / 3600, 6) as hours from passages group by 1",
    "f20_sizes": r"select lang, published, try_cast(nullif(regexp_extract(published, '^\s*([0-9]+\.?[0-9]*)\s*[MG]\s*$', 1), '') as double) * case when regexp_matches(published, 'G\s*$') then 1024 else 1 end as mb from resource_proxy",
    "f07_log_sizes": f"with {_RESOURCE} select lang, round(log10(mb), 6) as log10_mb from resource where mb is not null",
    "a19_extremes": f"with {_RESOURCE} select max(mb) as max_mb, min(mb) as min_mb, arg_max(lang, (mb, lang)) as largest, arg_min(lang, (mb, lang)) as smallest, round(max(mb) / min(mb), 3) as spread from resource where mb is not null",
    "a20_vocabularies": f"select task, list_sort(list(distinct size::int)) as sizes, count(*) as n_models from (values {', '.join(map(str, VOCABULARIES))}) t(task, size) group by 1",
    "v07_flagged": f"with {C.CTES}, {_ENCODERS} select lang, key, round(avg(ndcg10), 6) as ndcg10, not any_value(list_contains(missing, lang)) as declares_support, any_value(list_contains(missing, lang)) as coverage_confounded from scores, encoders where sys_name = '{SECOND}' group by lang, key",
    "z01_lengths": f"with {C.CTES} {_measured('passages', 'lang', X.passage_text_sql())}",
    "z02_length_ratios": f"with {C.CTES}, m as ({_measured('topics', 'lang', 'text')}) select lang, family, fertility, single_rate, tokens_per_char from m",
    "z03_length_validity": f"with {C.CTES}, m as ({_measured('topics', 'lang', 'text')}) select lang, fertility, lang not in {X.UNSEGMENTED} as word_measure_valid from m where family = 'char4'",
    "a15_outcome_profile": f"{_PROFILE} select lang, outcome, count(*) as n, round(avg(n_words), 3) as mean_words, round(avg(n_chars), 3) as mean_chars, round(avg(n_positives), 3) as mean_positives from outcomes left join shaped using (lang, qid) group by all",
    "z04_query_lengths": f"{_PROFILE} select lang, outcome, round(avg(per_word), 3) as mean_tokens_per_word from outcomes left join shaped using (lang, qid) group by all",
    "g01_report": f"{_REPORT} select * from report",
    "g02_scatter": f"{_REPORT}, {_ENCODERS} select lang, key, round(log10(mb), 6) as log10_mb, diff, low, high, not list_contains(missing, lang) as supported from report join (select lang, mb from resource where mb is not null) using (lang), encoders",
    "g03_stacked": f"{_CATS}, r as (select sys_name, lang, {_RATES} from cats where sys_name in ('{FIRST}', '{SECOND}') group by all), o as (select lang, row_number() over (order by rate_total_miss desc, lang) as place from r where sys_name = '{FIRST}') select place, lang, sys_name, {', '.join(f'rate_{c}' for c in L.CATEGORIES)} from r join o using (lang)",
    "j10_joined": f"{_PAIRS}, {_RESOURCE}, e as (select lang, round(avg(b.unjudged10 - a.unjudged10), 3) as difference from a join b using (lang, qid) where a.unjudged10 is not null and b.unjudged10 is not null group by 1) select lang, f as bm25_char4, s as dense_small, difference, mb from (select lang, round(avg(ndcg10), 6) f from a group by 1) join (select lang, round(avg(ndcg10), 6) s from b group by 1) using (lang) join e using (lang) join resource using (lang)",
}

