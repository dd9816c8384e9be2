"""Files, samples, sub-corpora and audits (survey groups S, R, J, U, K, A of the build path, Q and F of the audits)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.keys import clean_key, clean_key_sql
from ..functions.numbers import rounded
from ..operators import audit as A
from ..operators import sampling as R
from ..operators import statistics as S
from ..operators.ranking import with_place
from ..plans.materialise import materialise, passing_folder
from ..sources import collection as C
from ..sources import files as I
from ..sources.tables import table

SEED, TARGET, FEW, QUERIES_MOST, TEXTS = 20250317, 200, 20, 300, 2000


def _folder(spark) -> str:
    return passing_folder(spark, "files")


# files


def _sorted_passages(spark, d):
    return C.passages(spark, d).select("lang", "docid", "title", "text")


def s05_corpus_file(spark, d):
    """Every passage written as gzip JSON lines and read again, a language as part of the docid."""
    path = _folder(spark)
    I.write_corpus(_sorted_passages(spark, d).select(F.concat_ws("/", "lang", "docid").alias("docid"), "title", "text"), path)
    return I.read_corpus(spark, path)


def s03_shards(spark, d):
    """The files of a written corpus, by their suffix."""
    path = _folder(spark)
    I.write_corpus(_sorted_passages(spark, d).repartition(4), path)
    return I.shards(spark, path, ".json.gz").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "bytes")


def s04_volume(spark, d):
    path = _folder(spark)
    I.write_corpus(_sorted_passages(spark, d).repartition(4), path)
    return I.shard_volume(I.shards(spark, path, ".json.gz"))


def s06_topics_file(spark, d):
    """Every topic written as TSV, tabs and line ends as blanks, and read again."""
    path = _folder(spark)
    own = C.topics(spark, d).withColumn("text", F.trim(F.regexp_replace("text", r"[\r\n\t]+", " ")))
    I.write_topics(own.select(F.concat_ws("/", "lang", "qid").alias("qid"), "text"), path)
    return I.read_topics(spark, path)


def s07_judgments_file(spark, d):
    """Every judgment written as TSV and read again, those of topics that exist."""
    path, keyed = _folder(spark), F.concat_ws("/", "lang", "qid").alias("qid")
    I.write_judgments(C.judgments(spark, d).select(keyed, "docid", "rel"), path)
    return I.read_judgments(spark, path, C.topics(spark, d).select(keyed))


def s16_judgments_content(spark, d):
    """The lines of the TSV of judgments."""
    return C.judgments(spark, d).select(F.concat_ws("\t", "qid", F.lit("0"), "docid", F.col("rel").cast("string")).alias("line"))


def s08_language(spark, d):
    """The passages of one language out of a corpus partitioned by language."""
    path = _folder(spark)
    own = _sorted_passages(spark, d)
    own.write.partitionBy("lang").parquet(path)
    return spark.read.schema(own.schema).parquet(path).where("lang = 'sw'").select("lang", "docid", X.passage_text(F.col("title"), F.col("text")).alias("text"))


def s09_artifacts(spark, d):
    """Stored scores written as JSON with provenance and read by one schema, with the file's language."""
    path = _folder(spark)
    own = C.scores(spark, d).select("sys_name", "lang", "qid", "ndcg10")
    I.write_artifact(own, f"{path}/per_query", EXPERIMENT, "0" * 40)
    schema = T.StructType([T.StructField("sys_name", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("qid", T.StringType()), T.StructField("ndcg10", T.DoubleType()), T.StructField("unjudged10", T.IntegerType()), T.StructField("experiment_id", T.StringType())])
    return I.read_artifacts(spark, path, schema).select("sys_name", "lang", "qid", "ndcg10", "unjudged10", "experiment_id")


def s09_language_map(spark, d):
    """Mean scores written as one nested JSON map of languages a system, a file each, and read back by language."""
    path = _folder(spark)
    own = C.scores(spark, d).groupBy("sys_name", "lang").agg(rounded(F.avg("ndcg10"), 6).alias("ndcg10"), F.count(F.lit(1)).alias("n")).where("sys_name is not null")
    maps = own.groupBy("sys_name").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct(F.struct("ndcg10", "n").alias("bm25"))))).alias("languages"))  # a row a language
    if not I.write_whole_texts(maps.select(F.concat("sys_name", F.lit(".json")).alias("name"), F.to_json(F.struct("languages")).alias("text")), path, "name", "text"):
        return spark.createDataFrame([], "lang string, ndcg10 double, n bigint")
    return I.read_language_map(spark, f"{path}/*.json", "bm25: struct<ndcg10: double, n: bigint>").select("lang", "bm25.ndcg10", "bm25.n")


def s10_languages_of_files(spark, d):
    """Stored scores written as a JSON file a language, and the languages found by listing the files."""
    path = _folder(spark)
    own = C.scores(spark, d).groupBy("lang").agg(F.to_json(F.struct(rounded(F.avg("ndcg10"), 6).alias("ndcg10"))).alias("text"))
    if not I.write_whole_texts(own.select(F.concat(F.lit("per_query_"), "lang", F.lit(".json")).alias("name"), "text"), path, "name", "text"):
        return spark.createDataFrame([], "path string, lang string")
    found = I.shards(spark, path, ".json")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), I.language_of(F.col("path")).alias("lang"))


def s12_embedding_store(spark, d):
    """Vectors written as parquet by label and read again."""
    path = _folder(spark)
    stored = table(spark, d, "embeddings")
    stored.write.partitionBy("label").parquet(path)
    own = spark.read.schema(stored.schema).parquet(path)
    return own.select("vec_id", F.col("label").cast("int").alias("label"), rounded(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def s14_whole_texts(spark, d):
    """Documents' texts that are not empty written one a file and read whole: their lengths, a row a file."""
    path = _folder(spark)
    own = table(spark, d, "documents").select("doc_id", "text").where("doc_id is not null and text <> ''")
    named = own.select(F.concat("doc_id", F.lit("-"), F.xxhash64("text"), F.lit(".txt")).alias("name"), "text")
    if not I.write_whole_texts(named, path, "name", "text"):
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint")
    return I.read_whole_texts(spark, f"{path}/*.txt").select(F.regexp_extract("path", r"(-?[0-9]+)-(-?[0-9]+)\.txt$", 1).cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"))


def s11_json_leaves(spark, d):
    """Every leaf of every event's JSON."""
    return A.json_leaves(table(spark, d, "events"), "event_id", "props")


def s18_upsert(spark, d):
    """Stored scores with the rows of the latest build in place of older ones, by language."""
    own = C.scores(spark, d).groupBy("sys_name", "lang").agg(rounded(F.avg("ndcg10"), 6).alias("ndcg10"))
    new = own.where("lang < 'f'").withColumn("ndcg10", F.lit(1.0))
    return I.upsert(own, new, ["sys_name", "lang"])


def s20_bibtex(spark, d):
    """Each build's manifest as an entry of a bibliography."""
    own = table(spark, d, "metrics").where("lang is not null and git_commit is not null")
    return A.bibtex(own.select(F.col("build_id").alias("entry"), F.lit("misc").alias("kind"), F.create_map(F.lit("note"), F.col("git_commit"), F.lit("language"), F.col("lang")).alias("fields")))


# rows as they are read


def pr01_passage_text(spark, d):
    own = table(spark, d, "subcorpus")
    return own.select("rec_id", X.passage_text(F.col("title"), F.col("text")).alias("passage"))


def pr02_arity(spark, d):
    """Docids by the number of parts between `#`."""
    parts = F.size(F.split(clean_key(F.col("docid")), "#"))
    return table(spark, d, "qrels").where("docid is not null").where(clean_key(F.col("docid")).isNotNull()).where(parts >= 2).select("judgment_id", parts.cast("bigint").alias("n_parts"))


def pr03_known_queries(spark, d):
    """Judgments whose query exists."""
    return C.judgments(spark, d).join(C.topics(spark, d).select("lang", "qid"), ["lang", "qid"], "left_semi")


def pr04_passage_numbers(spark, d):
    """Passage numbers of judged docids, where they are integers."""
    number = F.substring_index(clean_key(F.col("docid")), "#", -1).try_cast("bigint")
    return table(spark, d, "qrels").select("judgment_id", number.alias("passage")).where("passage is not null")


def pr05_with_text(spark, d):
    return table(spark, d, "subcorpus").where("length(trim(text)) > 0").select("rec_id", F.length("text").cast("bigint").alias("n_chars"))


def pr14_remaining(spark, d):
    """Topics that the dense system has still to be evaluated on, by the artifact in which its scores are stored."""
    path = _folder(spark)
    I.write_artifact(C.scores(spark, d).where("sys_name = 'dense-small'").select("lang", "qid", "ndcg10"), path, "EXP", "0" * 40)
    done = I.read_artifacts(spark, path, T.StructType([T.StructField("lang", T.StringType()), T.StructField("qid", T.StringType())])).select("lang", "qid")
    return C.topics(spark, d).select("lang", "qid").join(done, ["lang", "qid"], "left_anti")


def f16_titles(spark, d):
    """Titles with single blanks, in lower case, and their letters alone."""
    squeezed = F.trim(F.regexp_replace("title", X.BLANKS, " "))
    return table(spark, d, "subcorpus").where("title is not null").select("rec_id", squeezed.alias("title"), F.regexp_replace(F.lower(squeezed), r"[^a-z]", "").alias("letters"))


# samples and sub-corpora


def _judged(spark, d):
    """(lang, docid) of every judged passage, once."""
    return C.judgments(spark, d).select("lang", "docid").distinct()


def _docids(spark, d):
    return C.passages(spark, d).select("lang", "docid")


def r01_queries(spark, d):
    """At most 300 queries a language, by lot."""
    return R.bottom_k(C.topics(spark, d), "lang", "qid", QUERIES_MOST, SEED).select("lang", "qid", "text")


def r02_others(spark, d):
    """Passages that nobody judged, by lot up to the target less the judged ones."""
    return R.sub_corpus(_docids(spark, d), _judged(spark, d), TARGET, SEED).where("not judged").select("lang", "docid")


def r03_texts(spark, d):
    """At most 2,000 passages with a text of each language, by lot, for counting tokens."""
    own = C.passages(spark, d).where("length(trim(text)) > 0").select("lang", "docid")
    return R.bottom_k(own, "lang", "docid", TEXTS, SEED)


def r04_resamples(spark, d, resamples=3):
    """Draws of each language's first resamples, as positions."""
    sizes = C.topics(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return S.draws(sizes, resamples, SEED)


def r04_resamples_full(spark, d):
    """Draws of all 10,000 resamples of each language."""
    return r04_resamples(spark, d, 10_000)


def u01_sub_corpus(spark, d):
    return R.sub_corpus(_docids(spark, d), _judged(spark, d), TARGET, SEED)


def a17_manifest(spark, d):
    judged = _judged(spark, d)
    return R.manifest(materialise(R.sub_corpus(_docids(spark, d), judged, TARGET, SEED)), judged, TARGET)


def a16_digest(spark, d):
    """The digest of each language's judged docids."""
    return R.sorted_digest(_judged(spark, d), "lang", "docid").withColumnRenamed("n_keys", "n_docids")


def a03_judged(spark, d):
    return C.judgments(spark, d).groupBy("lang").agg(F.countDistinct("docid").alias("n_docids"))


def j01_judged_passages(spark, d):
    return _docids(spark, d).join(_judged(spark, d), ["lang", "docid"], "left_semi")


def j02_other_passages(spark, d):
    return _docids(spark, d).join(_judged(spark, d), ["lang", "docid"], "left_anti")


def j03_first_missing(spark, d):
    return R.first_missing(R.missing_judged(_docids(spark, d), _judged(spark, d)), FEW)


def u03_missing(spark, d):
    return _judged(spark, d).subtract(_docids(spark, d))


def k03_order(spark, d):
    """Judgments with their place in the sorted file of their language."""
    return with_place(C.judgments(spark, d).select("lang", "qid", "docid"), ["lang"], ["qid", "docid"])


def k07_languages(spark, d):
    order = R.Window.orderBy("lang")
    return table(spark, d, "metrics").select("lang").where("lang is not null").distinct().withColumn("place", F.row_number().over(order).cast("bigint"))


# audits

#: The name under which stored scores are written.
EXPERIMENT = "EXP-004"
#: Required and forbidden wording of queries.
REQUIRED, FORBIDDEN = {"ends with a question mark": r"[?？؟]\s*\z"}, {"names no year": r"\b(1[5-9]|20)[0-9]{2}\b"}


def q01_numbers(spark, d):
    """Numbers in documents that no number anywhere in a build's manifest accounts for; manifests are read as JSON, leaf by leaf."""
    tokens = A.numbers(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    own = table(spark, d, "metrics")
    leaves = A.json_leaves(own.select("build_id", F.to_json(F.struct(*own.columns)).alias("manifest")), "build_id", "manifest")
    allowed = spark.createDataFrame([("0",), ("1",)], "token string")
    return A.untraced(tokens, A.rendered_values(leaves, "number"), allowed)


def f11_numbers(spark, d):
    """The numbers of every document's text, distinct."""
    return A.numbers(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


def f10_renderings(spark, d):
    """Ways to write each manifest's judged share."""
    return table(spark, d, "metrics").where("judged_fraction is not null").select("build_id", F.explode(X.renderings(F.col("judged_fraction"))).alias("shown"))


def _latex(spark, d):
    """A text that cites each judged passage as LaTeX would, one a query, and a bibliography of the passages there are."""
    cite = F.concat(F.lit("Query "), "qid", F.lit(r" \cite{"), F.array_join(F.array_sort(F.collect_set("docid")), ", "), F.lit(r"} of 100\% % \cite{none}"))
    texts = C.judgments(spark, d).where("rel > 0").groupBy("lang", "qid").agg(cite.alias("text"))
    entries = _docids(spark, d).select(F.concat(F.lit("@Misc{"), "docid", F.lit(", title = {x}}")).alias("text"))
    return texts.select(F.concat_ws("/", "lang", "qid").alias("key"), "text"), entries


def q02_citations(spark, d):
    texts, entries = _latex(spark, d)
    return A.citation_report(A.cited_keys(texts, "key", "text"), A.bibliography(entries, "text"))


def u04_cited(spark, d):
    return A.cited_keys(_latex(spark, d)[0], "key", "text")


def f14_entries(spark, d):
    return A.bibliography(_latex(spark, d)[1], "text")


def q03_wording(spark, d):
    own = C.topics(spark, d).select(F.concat_ws("/", "lang", "qid").alias("key"), "text")
    return A.wording(own, "key", "text", REQUIRED, FORBIDDEN)


def f15_context(spark, d):
    """What stands around the word `kernel` in documents."""
    return table(spark, d, "documents").where("text like '%kernel%'").select("doc_id", A.context(F.col("text"), "kernel", 20).alias("around"))


def q04_references(spark, d):
    """Judged passages checked against an Atom feed that has an entry for each passage there is: title, year and authors."""
    own = table(spark, d, "subcorpus").select("lang", clean_key(F.col("docid")).alias("docid"), "title", "text", "received_at", "rec_id")
    own = C.latest(own.withColumn("published", F.date_format("received_at", "yyyy-MM-dd")), ["lang", "docid"], ["received_at", "rec_id"])
    escaped = F.regexp_replace(F.coalesce("title", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(shown))
    second = F.when(F.length("text") > 0, F.lit("<author><name>Second</name></author>")).otherwise(F.lit(""))
    feed = F.concat(F.lit("<feed><entry><id>http://feed/abs/"), "lang", F.lit(":"), "docid", F.lit("v2</id><title>"), escaped, F.lit("</title><published>"), "published", F.lit("</published><author><name>First</name></author>"), second, F.lit("</entry></feed>"))
    entries = I.atom_entries(own.select(feed.alias("feed")), "feed")
    cited = C.judgments(spark, d).select(F.concat_ws(":", "lang", "docid").alias("id"))
    return A.reference_check(cited, entries.withColumn("title", F.coalesce("title", F.lit(""))))


def q05_upgraded(spark, d):
    """Manifests as entries, those of later builds with a venue."""
    own = table(spark, d, "metrics").select(F.col("build_id").alias("entry"), F.lit("misc").alias("kind"), F.create_map(F.lit("language"), F.col("lang")).alias("fields"))
    venues = table(spark, d, "metrics").where("build_id like '%1'").select(F.col("build_id").alias("entry"), F.lit("inproceedings").alias("kind"), F.concat(F.lit("Venue of "), "lang").alias("venue"))
    return A.upgraded(own, venues).select("entry", "kind", "venue")


def f12_stripped(spark, d):
    """The citing texts without comments and keys."""
    return _latex(spark, d)[0].select("key", A.without_commands(A.without_comments(F.col("text"))).alias("text"))


def f17_sha256(spark, d):
    return C.topics(spark, d).select("lang", "qid", F.sha2("text", 256).alias("sha256"))


_Q = (f12_stripped, f17_sha256, s03_shards, s04_volume, s05_corpus_file, s06_topics_file, s07_judgments_file, s08_language, s09_artifacts, s09_language_map, s10_languages_of_files, s11_json_leaves, s12_embedding_store, s14_whole_texts, s16_judgments_content, s18_upsert, s20_bibtex, pr01_passage_text, pr02_arity, pr03_known_queries, pr04_passage_numbers, pr05_with_text, pr14_remaining, f16_titles, r01_queries, r02_others, r03_texts, r04_resamples, r04_resamples_full, u01_sub_corpus, a17_manifest, a16_digest, a03_judged, j01_judged_passages, j02_other_passages, j03_first_missing, u03_missing, k03_order, k07_languages, q01_numbers, f10_renderings, f11_numbers, q02_citations, u04_cited, f14_entries, q03_wording, q04_references, f15_context, q05_upgraded)
QUERIES = {q.__name__: q for q in _Q}

_LOT = "md5('{seed}:' || lang || ':' || {key})".replace("{seed}", str(SEED))
_SUB = f"""judged as (select distinct lang, docid from judgments), marked as (select lang, p.docid, j.docid is not null as judged from passages p left join judged j using (lang, docid)),
  kept as (select lang, count(*) n from marked where judged group by 1),
  lots as (select lang, docid, row_number() over (partition by lang order by {_LOT.format(key='docid')}, docid) place from marked where not judged),
  sub as (select lang, docid, true as judged from marked where judged union all select lang, docid, false from lots left join kept using (lang) where place + coalesce(n, 0) <= {TARGET})"""
_B = C.CTES
_ANY = "select lang, docid from {0}"
_TEXTS = r"""texts as (select lang || '/' || qid as key, 'Query ' || qid || ' \cite{' || string_agg(distinct docid, ', ' order by docid) || '} of 100\% % \cite{none}' as text from judgments where rel > 0 group by lang, qid)"""
_CITED = f"{_TEXTS}, cited as (select distinct lang || '/' || qid as key, trim(unnest(string_split(docid, ',')), ' ') as cited from judgments where rel > 0)"
_NUMBERS = r"""numbers as (select distinct doc_id, rtrim(unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '(^|[^\\\n])%[^\n]*', '\1', 'g'), '\\(cite|label|ref)\{[^}]*\}', ' ', 'g'), '[0-9]+\.?[0-9]*')), '.') as token from documents)"""
#: The columns of the manifest that are numbers.
MANIFEST_NUMBERS = ("seed", "q_max", "n_target", "n_actual", "n_queries", "n_judged_docs_expected", "n_judged_docs_found", "n_judged_docs_missing", "judged_fraction", "corpus_total_docs_streamed", "corpus_shards", "n_docs_per_language")


def _shown(x: str) -> str:
    """The ways to write a number, in SQL."""
    to = lambda v, p: f"printf('%.{p}f', round({v}, {p}))"
    bare = lambda v, p: rf"regexp_replace(regexp_replace({to(v, p)}, '(\.[0-9]*?)0+$', '\1'), '\.$', '')"
    return f"list_distinct([{bare(x, 4)}, {bare(f'abs({x})', 4)}, {', '.join(to(f'abs({x})', p) for p in (4, 3, 2))}, {bare(f'abs({x})', 3)}, {bare(f'abs({x})', 2)}])"


SQL = {
    "s05_corpus_file": f"with {_B} select lang || '/' || docid as docid, coalesce(title, '') as title, coalesce(text, '') as text from passages",
    "s06_topics_file": f"with {_B} select lang || '/' || qid as qid, trim(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), ' ') as text from topics",
    "s07_judgments_file": f"with {_B} select lang || '/' || qid as qid, docid, rel from judgments semi join topics using (lang, qid)",
    "s08_language": f"with {_B} select lang, docid, {X.passage_text_sql()} as text from passages where lang = 'sw'",
    "s09_artifacts": f"with {_B} select sys_name, lang, qid, ndcg10, null::int as unjudged10, '{EXPERIMENT}' as experiment_id from scores",
    "s09_language_map": f"with {_B} select lang, round(avg(ndcg10), 6) as ndcg10, count(*) as n from scores where sys_name is not null group by sys_name, lang",
    "s10_languages_of_files": f"with {_B} select distinct 'per_query_' || lang || '.json' as path, lang from scores",
    "s14_whole_texts": "select doc_id, length(text) as n_chars from documents where text <> ''",
    "s12_embedding_store": "select vec_id, label, round(list_sum(embedding::double[]), 6) as total from embeddings",
    "s16_judgments_content": f"with {_B} select qid || chr(9) || '0' || chr(9) || docid || chr(9) || rel as line from judgments",
    "s18_upsert": f"with {_B} select sys_name, lang, case when lang < 'f' then 1.0::double else round(avg(ndcg10), 6) end as ndcg10 from scores group by sys_name, lang",
    "s20_bibtex": "select build_id as entry, '@misc{' || build_id || ',' || chr(10) || '  language = {' || lang || '},' || chr(10) || '  note = {' || git_commit || '}' || chr(10) || '}' as text from metrics where lang is not null and git_commit is not null",
    "pr01_passage_text": f"select rec_id, {X.passage_text_sql()} as passage from subcorpus",
    "pr02_arity": f"select judgment_id, len(string_split(k, '#')) as n_parts from (select judgment_id, {clean_key_sql('docid')} k from qrels) where len(string_split(k, '#')) >= 2",
    "pr03_known_queries": f"with {_B} select lang, qid, docid, rel from judgments semi join topics using (lang, qid)",
    "pr04_passage_numbers": f"select judgment_id, try_cast(string_split(k, '#')[-1] as bigint) as passage from (select judgment_id, {clean_key_sql('docid')} k from qrels) where try_cast(string_split(k, '#')[-1] as bigint) is not null",
    "pr05_with_text": "select rec_id, length(text) as n_chars from subcorpus where length(trim(text, ' ')) > 0",
    "pr14_remaining": f"with {_B} select lang, qid from topics anti join (select lang, qid from scores where sys_name = 'dense-small') using (lang, qid)",
    "f16_titles": f"select rec_id, t as title, regexp_replace(lower(t), '[^a-z]', '', 'g') as letters from (select rec_id, trim(regexp_replace(title, '{X.BLANKS}', ' ', 'g'), ' ') t from subcorpus where title is not null)",
    "r01_queries": f"with {_B} select lang, qid, text from topics qualify row_number() over (partition by lang order by {_LOT.format(key='qid')}, qid) <= {QUERIES_MOST}",
    "r02_others": f"with {_B}, {_SUB} select lang, docid from sub where not judged",
    "r03_texts": f"with {_B} select lang, docid from passages where length(trim(text, ' ')) > 0 qualify row_number() over (partition by lang order by {_LOT.format(key='docid')}, docid) <= {TEXTS}",
    "r04_resamples": f"with {_B}, sizes as (select lang, count(*) n from topics group by 1) select lang, b, draw, ('0x' || substr(md5('{SEED}:' || lang || ':' || b || ':' || draw), 1, 8))::bigint % n as i from (select lang, n, b, unnest(range(1, n + 1)) draw from sizes, range(1, 4) t(b))",
    "u01_sub_corpus": f"with {_B}, {_SUB} select lang, docid, judged from sub",
    "a17_manifest": f"""with {_B}, {_SUB}, e as (select lang, count(*) n from judged group by 1), s as (select lang, count(*) a, count(*) filter (where judged) f, sha256(string_agg(docid, chr(10) order by docid)) h from sub group by 1)
      select lang, {TARGET} as n_target, a as n_actual, coalesce(n, 0) as n_judged_docs_expected, f as n_judged_docs_found, coalesce(n, 0) - f as n_judged_docs_missing, round(f / a, 4) as judged_fraction, h as docid_sha256 from s left join e using (lang)""",
    "a16_digest": f"with {_B} select lang, count(*) as n_docids, sha256(string_agg(docid, chr(10) order by docid)) as sha256 from (select distinct lang, docid from judgments) group by 1",
    "a03_judged": f"with {_B} select lang, count(distinct docid) as n_docids from judgments group by 1",
    "j01_judged_passages": f"with {_B} select lang, docid from passages semi join judgments using (lang, docid)",
    "j02_other_passages": f"with {_B} select lang, docid from passages anti join judgments using (lang, docid)",
    "j03_first_missing": f"with {_B}, m as (select distinct lang, docid from judgments anti join passages using (lang, docid)) select lang, list(docid order by docid)[1:{FEW}] as missing_judged_sample from m group by 1",
    "u03_missing": f"with {_B} select lang, docid from judgments except select lang, docid from passages",
    "k03_order": f"with {_B} select lang, qid, docid, row_number() over (partition by lang order by qid, docid) as place from judgments",
    "k07_languages": "select lang, row_number() over (order by lang) as place from (select distinct lang from metrics where lang is not null)",
    "f11_numbers": f"with {_NUMBERS} select doc_id, token from numbers where token is not null",
    "s11_json_leaves": "select event_id, fullkey as path, case when type in ('UBIGINT', 'BIGINT', 'DOUBLE') then atom::double when type = 'BOOLEAN' then (atom = 'true')::int::double end as number, case when type = 'VARCHAR' then atom ->> '$' end as string from events, json_tree(props) where type not in ('OBJECT', 'ARRAY', 'NULL')",
    "f10_renderings": f"select build_id, unnest({_shown('judged_fraction')}) as shown from metrics where judged_fraction is not null",
    "q01_numbers": f"""with {_NUMBERS}, leaves as (select unnest([{', '.join(f'{c}::double' for c in MANIFEST_NUMBERS)}]) v from metrics), shown as (select distinct unnest({_shown('v')}) s from leaves where v is not null)
      select doc_id, token from numbers where token not in ('0', '1') and token not in (select s from shown)
        and token not in (select t from (select distinct token t from numbers), shown where length(s) > 3 and (starts_with(s, t) or length(t) > 3 and starts_with(t, s)))""",
    "q02_citations": f"with {_B}, {_CITED}, d as (select distinct docid as name from passages), c as (select distinct cited as name from cited) select name, 'missing' as problem from c anti join d using (name) union all select name, 'unused' from d anti join c using (name)",
    "f12_stripped": rf"with {_B}, {_TEXTS} select key, regexp_replace(regexp_replace(text, '(^|[^\\\n])%[^\n]*', '\1', 'g'), '\\(cite|label|ref)\{{[^}}]*\}}', ' ', 'g') as text from texts",
    "f17_sha256": f"with {_B} select lang, qid, sha256(text) as sha256 from topics",
    "u04_cited": f"with {_B}, {_CITED} select key, cited from cited where cited <> ''",
    "f14_entries": f"with {_B} select distinct docid as entry, 'misc' as kind from passages",
    "q03_wording": f"with {_B} select lang || '/' || qid as key, label, case label when 'ends with a question mark' then regexp_matches(text, '[?？؟]\\s*\\z') else not regexp_matches(text, '\\b(1[5-9]|20)[0-9]{{2}}\\b') end as passed from topics, (values ('ends with a question mark'), ('names no year')) l(label)",
    "f15_context": r"select doc_id, coalesce(regexp_extract(text, '.{0,20}\bkernel\b.{0,20}'), '') as around from documents where text like '%kernel%'",
    "q04_references": rf"""with {_B}, entries as (select lang || ':' || docid id, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g'), ' ') title, strftime(received_at, '%Y') as year, 1 + (coalesce(length(text), 0) > 0)::bigint n
        from (select * replace ({clean_key_sql('docid')} as docid) from subcorpus) where lang is not null and docid is not null qualify row_number() over (partition by lang, docid order by received_at desc, rec_id desc) = 1)
      select id, case when n is null then 'NOT_FOUND' else 'VERIFIED' end as status, title, year, n as n_authors from (select distinct lang || ':' || docid id from judgments) left join entries using (id)""",
    "q05_upgraded": "select build_id as entry, case when build_id like '%1' then 'inproceedings' else 'misc' end as kind, case when build_id like '%1' then 'Venue of ' || lang end as venue from metrics",
}
