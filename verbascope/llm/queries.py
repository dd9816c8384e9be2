"""Named queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import clean_key, clean_key_sql, page_of
from ..operators.sampling import sorted_digest
from ..plans.materialise import shared_folder
from ..sources.tables import table
from . import bpe, budget, lookalike, packing, reservoir, stable_sample, subjects

#: Passages a language in the sample of fixed size, and keys that a task's buffer holds before it is flushed.
SAMPLE_SIZE, SAMPLE_BUFFER, SAMPLE_SEED = 2000, 500, 20250317
#: Share of a language's passages in the stable sample, and the higher share of languages with little text.
STABLE_RATE, STABLE_RATE_LOW, LOW_LANGUAGES = 0.05, 0.2, ("yo", "sw")
#: Tokens of a container.
CAPACITY = 2048


# 1: a sample of fixed size


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """(lang, docid, rec_id): every passage once, as it was delivered last."""
    rows = table(spark, d, "subcorpus").select("lang", clean_key(F.col("docid")).alias("docid"), "received_at", "rec_id")
    latest = F.max(F.struct("received_at", "rec_id"))
    return rows.where("lang is not null and docid is not null").groupBy("lang", "docid").agg(latest.alias("latest")).select("lang", "docid", "latest.rec_id")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    chosen = reservoir.fixed_size_sample(_passages(spark, d), "lang", "rec_id", SAMPLE_SIZE, SAMPLE_SEED, SAMPLE_BUFFER)
    texts = table(spark, d, "subcorpus").select("rec_id", clean_key(F.col("docid")).alias("docid"), "text")
    return reservoir.fetch(chosen, texts, "rec_id").select("lang", "docid", "text")


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many passages of each language the sample holds, each of them once."""
    return p1_sample(spark, d).groupBy("lang").agg(F.countDistinct("docid").alias("n_sampled"), F.count(F.lit(1)).alias("n_rows"))


# 2: one form for what looks the same

LOOKS = {0: ("subcorpus", "text"), 1: ("subcorpus", "title"), 2: ("queries", "text")}


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Every text and title with its kind and the scope in which it is compared."""
    corpus, queries = table(spark, d, "subcorpus"), table(spark, d, "queries")
    kind = lambda i: F.lit(i).alias("kind")
    return (
        corpus.select(kind(0), F.col("rec_id").alias("id"), F.lit("").alias("scope"), "lang", F.col("text").alias("value"))
        .unionByName(corpus.select(kind(1), F.col("rec_id").alias("id"), page_of(F.col("docid")).alias("scope"), "lang", F.col("title").alias("value")))
        .unionByName(queries.select(kind(2), F.col("q_rec").alias("id"), F.lit("").alias("scope"), "lang", F.col("text").alias("value")))
    )


def _looks(i: int, alias: str):
    return F.element_at(F.create_map(*(F.lit(x) for k, v in LOOKS.items() for x in (k, v[i]))), F.col("kind")).alias(alias)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(_values(spark, d)).select(_looks(0, "tab"), _looks(1, "field"), "id_a", "id_b")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The rows that look like others as classes of forms and of spellings, a row each."""
    return lookalike.look_alike_classes(_values(spark, d)).select(_looks(0, "tab"), _looks(1, "field"), "id", "form_id", "spelling_id")


def p2_queries(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normal_forms(table(spark, d, "queries"), ["q_rec"], "lang", "text")


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normal_forms(table(spark, d, "subcorpus"), ["rec_id"], "lang", "text")


def p2_titles(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normal_forms(table(spark, d, "subcorpus"), ["rec_id"], "lang", "title")


# 4: a sample that stays


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """(lang, salt, threshold) in force for these tables: at first the seed of a language's first build that has one, and its rate; from then on what is stored below the shared folder."""
    seeds = table(spark, d, "metrics").where("seed is not null and lang is not null")
    rate = F.when(F.col("lang").isin(*LOW_LANGUAGES), STABLE_RATE_LOW).otherwise(STABLE_RATE)
    wanted = seeds.groupBy("lang").agg(F.min_by("seed", F.struct("built_utc", "build_id")).alias("salt")).withColumn("threshold", stable_sample.threshold(rate))
    return stable_sample.rules_in_force(wanted, "lang", f"{shared_folder(spark)}/stable-sample/{hashlib.md5(d.encode()).hexdigest()}")


def _docids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subcorpus").select("lang", "build_id", clean_key(F.col("docid")).alias("docid"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    rules = _rules(spark, d)
    return stable_sample.stable_sample(_docids(spark, d).select("lang", "docid").distinct(), "lang", "docid", rules.select("lang", "salt"), rules.select("lang", "threshold"))


def p4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return stable_sample.fingerprint(p4_sample(spark, d).select("lang", "docid"), ["lang"], "docid")


def p4_builds(spark: SparkSession, d: str) -> DataFrame:
    """Each build's docids, as the manifest's fingerprint has them, and whether that fingerprint is up to date."""
    own = sorted_digest(_docids(spark, d).select("build_id", "docid").distinct(), "build_id", "docid")
    return table(spark, d, "metrics").select("build_id", "docid_sha256").join(own, "build_id", "left").select(
        "build_id", F.coalesce("n_keys", F.lit(0)).alias("n_docids"), "sha256", F.coalesce(F.col("sha256") == F.col("docid_sha256"), F.lit(False)).alias("up_to_date")
    )


# 5: token budgets


def _documents(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents")
    return own.select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_id"), "source", budget.plain_language(F.col("lang")).alias("lang"), budget.plain_name(F.col("text_domain")).alias("text_domain"), F.lit(None).cast("string").alias("build_id"), "text")


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    own, none = table(spark, d, "subcorpus"), F.lit(None).cast("string")
    return own.select(F.lit("subcorpus").alias("tab"), F.col("rec_id").alias("row_id"), none.alias("source"), budget.plain_language(F.col("lang")).alias("lang"), none.alias("text_domain"), "build_id", "text")


def p5_budget(spark: SparkSession, d: str) -> DataFrame:
    """Totals of both tables by their slices, next to the builds' sample sizes."""
    both = _documents(spark, d).unionByName(_deliveries(spark, d))
    totals = budget.token_totals(both, ["tab", "source", "lang", "text_domain", "build_id"], "text")
    sizes = table(spark, d, "metrics").select("build_id", "n_docs_per_language")
    return totals.join(sizes, "build_id", "left")


def p5_slices(spark: SparkSession, d: str) -> DataFrame:
    """The texts, and the distinct ones, of which the totals are."""
    return p5_budget(spark, d).select("tab", "source", "lang", "text_domain", "build_id", "n_texts", "n_distinct", "n_docs_per_language")


def p5_tokens(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_counts(_documents(spark, d).unionByName(_deliveries(spark, d)), ["tab", "row_id"], "text")


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of both tables by language alone."""
    both = _documents(spark, d).unionByName(_deliveries(spark, d))
    return budget.token_totals(both, ["tab", "lang"], "text")


# 6: token ids


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return bpe.decode_ids(p6_ids(spark, d), "doc_id")


# 7: containers of one capacity


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").withColumn("lang", budget.plain_language(F.col("lang")))
    return packing.pack(own, "doc_id", "lang", "text", CAPACITY)


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document is in the containers from its first token on without a gap, and whether it had any."""
    own = p7_containers(spark, d).groupBy("doc_id").agg(F.max(F.col("first_token") + F.col("n_tokens")).alias("ends"), F.sum("n_tokens").alias("held"), F.count("container").alias("n_containers"))
    return own.select("doc_id", (F.col("ends") == F.col("held")).alias("whole"), (F.col("n_containers") == 0).alias("empty"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, by tenths of the capacity, and how their texts came there: seeds, neighbours with their mean rank, gaps."""
    how = lambda x: F.count_if(F.col("placed") == x)
    filled = p7_containers(spark, d).where("container is not null").groupBy("container").agg(
        F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_texts"), how("neighbour").alias("n_neighbours"), how("gap").alias("n_in_gaps"), F.sum("rank").alias("ranks")
    )
    total = lambda c: F.sum(c).alias(c)
    return filled.groupBy(F.floor(F.col("n_tokens") * 10 / CAPACITY).alias("tenths")).agg(
        F.count(F.lit(1)).alias("n_containers"), total("n_texts"), total("n_tokens"), total("n_neighbours"), total("n_in_gaps"), F.try_divide(F.sum("ranks"), F.sum("n_neighbours")).alias("mean_rank")
    )


# 8: subjects


def _subjects(spark: SparkSession, d: str) -> list[str]:
    """The names of the few subjects."""
    return sorted(r.subject for r in subjects.few(table(spark, d, "subjects").where("subject is not null").select("subject").distinct(), "subjects"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = subjects.plain_documents(table(spark, d, "documents"))
    return subjects.document_subjects(documents, table(spark, d, "subject_labels"), _subjects(spark, d)).distinct()


def p8_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus measured by subject and language: documents, and sentences that treat it."""
    documents = subjects.plain_documents(table(spark, d, "documents"))
    shares = subjects.subject_shares(documents, table(spark, d, "subject_labels"), _subjects(spark, d))
    counted = shares.groupBy("doc_id", "subject").agg(F.max("n_treating").alias("n_treating"), F.max("n_sentences").alias("n_sentences"))
    own = counted.join(documents.select("doc_id", "lang"), "doc_id")
    return own.groupBy("subject", "lang").agg(F.count_if(F.col("n_treating") > F.col("n_sentences") * subjects.SHARE).alias("n_documents"), F.sum("n_treating").alias("n_sentences"))


QUERIES = {q.__name__: q for q in (p1_sample, p1_sizes, p2_found, p2_classes, p2_queries, p2_texts, p2_titles, p4_sample, p4_fingerprints, p4_builds, p5_budget, p5_slices, p5_tokens, p5_languages, p6_ids, p6_decoded, p7_containers, p7_coverage, p7_fill, p8_found, p8_corpus)}

_SAMPLE_SQL = f"""
  salts as (select lang, arg_min(seed, struct_pack(b := built_utc, i := build_id)) salt from metrics where seed is not null group by lang),
  docids as (select distinct lang, {clean_key_sql('docid')} docid from subcorpus),
  hashed as (select lang, docid, ('0x' || substr(sha256(salt || ':' || lang || ':' || docid), 1, 15))::bigint key_hash,
      case when lang in {LOW_LANGUAGES} then {STABLE_RATE_LOW} else {STABLE_RATE} end::double rate
    from docids join salts using (lang) where docid is not null),
  sample as (select lang, docid, key_hash from hashed where key_hash < floor(rate * {stable_sample.SPACE}::double)::bigint)"""
_PART = "lpad(to_hex(sum(('0x' || substr(sha256(docid), {}, 8))::bigint) % 4294967296), 8, '0')"
SQL = {
    "p4_sample": f"with {_SAMPLE_SQL} select * from sample",
    "p4_fingerprints": f"with {_SAMPLE_SQL} select lang, count(*) as n_keys, lower({' || '.join(_PART.format(i) for i in range(1, 64, 8))}) as fingerprint from sample group by lang",
    "p4_builds": f"""with docids as (select distinct build_id, {clean_key_sql('docid')} docid from subcorpus),
      own as (select build_id, count(*) n, sha256(string_agg(docid, chr(10) order by docid)) h from docids where docid is not null group by 1)
      select build_id, coalesce(n, 0) as n_docids, h as sha256, coalesce(h = docid_sha256, false) as up_to_date from metrics left join own using (build_id)""",
    "p1_sizes": f"select lang, least(count(distinct docid), {SAMPLE_SIZE}) as n_sampled, least(count(distinct docid), {SAMPLE_SIZE}) as n_rows from (select lang, {clean_key_sql('docid')} docid from subcorpus) where lang is not null and docid is not null group by lang",
    "p5_slices": f"""with both_tables as (select 'documents' as tab, source, lang, text_domain, null::varchar as build_id, text from documents union all select 'subcorpus', null, lang, null, build_id, text from subcorpus),
      plain as (select tab, source, nullif(lower(string_split(trim(lang, ' '), '-')[1]), '') as lang, nullif(lower(regexp_replace(text_domain, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '') as text_domain, build_id, text from both_tables)
      select tab, source, p.lang, text_domain, p.build_id, count(*) as n_texts, count(distinct nullif(text, '')) as n_distinct, any_value(n_docs_per_language) as n_docs_per_language from plain p left join metrics m on p.build_id = m.build_id group by all""",
    "p7_coverage": "select doc_id, true as whole, coalesce(text, '') = '' as empty from documents",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
