"""The collection as it is meant, out of what was delivered: one row a passage, topic, judgment and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import clean_key, clean_key_sql
from .tables import table


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in `order`; rows with a null key are left out. Copies are merged before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    there = df.where(" and ".join(f"{k} is not null" for k in keys))
    row = there.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return row.select(*keys, "row.*")


def passages(spark: SparkSession, d: str) -> DataFrame:
    """(lang, docid, title, text): each passage as it was delivered last."""
    own = table(spark, d, "subcorpus").select("lang", clean_key(F.col("docid")).alias("docid"), "title", "text", "received_at", "rec_id")
    return latest(own, ["lang", "docid"], ["received_at", "rec_id"])


def topics(spark: SparkSession, d: str) -> DataFrame:
    """(lang, qid, text): each query by its last delivery with a text."""
    own = table(spark, d, "queries").select("lang", clean_key(F.col("qid")).alias("qid"), F.trim("text").alias("text"), "created_at", "q_rec")
    return latest(own.where("text <> ''"), ["lang", "qid"], ["created_at", "q_rec"])


def judgments(spark: SparkSession, d: str) -> DataFrame:
    """(lang, qid, docid, rel): each judgment with a grade; of repeated ones the last."""
    own = table(spark, d, "qrels").select("lang", clean_key(F.col("qid")).alias("qid"), clean_key(F.col("docid")).alias("docid"), "rel", "judged_at", "judgment_id")
    return latest(own.where("rel is not null"), ["lang", "qid", "docid"], ["judged_at", "judgment_id"])


METRICS = ["ndcg10", "recall100", "mrr10", "n_positives", "unjudged10", "unjudged100"]


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(sys_name, lang, qid, *METRICS): each system's last evaluation of each query."""
    own = table(spark, d, "per_query").select("sys_name", "lang", clean_key(F.col("qid")).alias("qid"), *METRICS, "evaluated_at", "pq_id")
    return latest(own, ["sys_name", "lang", "qid"], ["evaluated_at", "pq_id"])


def _latest_sql(columns: str, keys: str, order: str, source: str, where: str = "true") -> str:
    there = " and ".join(f"{k.strip()} is not null" for k in keys.split(","))
    return f"(select {keys}, {columns} from (select *, row_number() over (partition by {keys} order by {order}) rn from ({source}) where {where}) where rn = 1 and {there})"


PASSAGES_SQL = _latest_sql("title, text", "lang, docid", "received_at desc, rec_id desc", f"select * replace ({clean_key_sql('docid')} as docid) from subcorpus")
TOPICS_SQL = _latest_sql("text", "lang, qid", "created_at desc, q_rec desc", f"select * replace ({clean_key_sql('qid')} as qid, trim(text, ' ') as text) from queries", "text <> ''")
JUDGMENTS_SQL = _latest_sql("rel", "lang, qid, docid", "judged_at desc, judgment_id desc", f"select * replace ({clean_key_sql('qid')} as qid, {clean_key_sql('docid')} as docid) from qrels", "rel is not null")
SCORES_SQL = _latest_sql(", ".join(METRICS), "sys_name, lang, qid", "evaluated_at desc, pq_id desc", f"select * replace ({clean_key_sql('qid')} as qid) from per_query")
#: The four as common table expressions.
CTES = f"passages as {PASSAGES_SQL}, topics as {TOPICS_SQL}, judgments as {JUDGMENTS_SQL}, scores as {SCORES_SQL}"
