"""Orphan references (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.keys import clean_key_sql
from ..operators import references as R
from ..sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    removals = table(spark, d, "removals")
    events = R.parent_events(table(spark, d, "subcorpus"), "subcorpus", "docid", "received_at", True)
    events = events.unionByName(R.parent_events(table(spark, d, "queries"), "queries", "qid", "created_at", True))
    for target in ("subcorpus", "queries"):
        events = events.unionByName(R.parent_events(removals.where(removals.tab == target), target, "ref_key", "removed_at", False))
    return events


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    judgments = R.references(table(spark, d, "qrels"), "qrels", "judgment_id", "subcorpus", "docid", "judged_at")
    scores = R.references(table(spark, d, "per_query"), "per_query", "pq_id", "queries", "qid", "evaluated_at")
    return R.resolve_references(judgments.unionByName(scores), _events(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(_resolved(spark, d)).select("tab", "row_id")


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(_resolved(spark, d))


def p3_claims(spark: SparkSession, d: str) -> DataFrame:
    qrels = table(spark, d, "qrels")
    resolved = R.resolve_references(R.references(qrels, "qrels", "judgment_id", "subcorpus", "docid", "judged_at"), _events(spark, d))
    return R.judged_claims(resolved, qrels.selectExpr("judgment_id row_id", "build_id"), table(spark, d, "metrics").select("build_id", "n_judged_docs_missing"))


_K = clean_key_sql
_RESOLVED = f"""
events as (
  select 'subcorpus' target, lang, {_K('docid')} k, received_at t, 1 present from subcorpus
  union all select 'queries', lang, {_K('qid')}, created_at, 1 from queries
  union all select tab, lang, {_K('ref_key')}, removed_at, 0 from removals),
refs as (
  select 'qrels' tab, judgment_id row_id, 'subcorpus' target, lang, {_K('docid')} k, judged_at t from qrels
  union all select 'per_query', pq_id, 'queries', lang, {_K('qid')}, evaluated_at from per_query),
states as (
  select r.tab, r.row_id, any_value(r.t) seen_at, any_value(r.lang) lang, any_value(r.k) k,
    max(case when e.t <= r.t then struct_pack(t := e.t, p := e.present) end).p there,
    min(case when e.present = 1 then e.t end) first_there
  from refs r left join events e on e.target = r.target and e.lang = r.lang and e.k = r.k
  group by r.tab, r.row_id),
resolved as (
  select tab, row_id, seen_at, lang, k, case when lang is null or k is null then 'empty' when seen_at is null then 'undated'
    when there = 1 then 'found' when first_there is null then 'missing' when first_there > seen_at then 'late' else 'deleted' end status
  from states)
"""

QUERIES = {"p3_found": p3_found, "p3_by_month": p3_by_month, "p3_claims": p3_claims}
SQL = {
    "p3_found": f"with {_RESOLVED} select tab, row_id from resolved where status in ('missing', 'deleted', 'late')",
    "p3_by_month": f"with {_RESOLVED} select tab, strftime(seen_at, '%Y-%m') as month, count(*) as n_references, "
    + ", ".join(f"count(*) filter (where status = '{s}') as n_{s}" for s in (R.FOUND, R.MISSING, R.DELETED, R.LATE, R.EMPTY, R.UNDATED))
    + " from resolved group by 1, 2",
    "p3_claims": f"""with {_RESOLVED},
      keys as (select q.build_id, r.lang, r.k, min(case when status = 'found' then 0 else 1 end) absent
        from resolved r join qrels q on r.tab = 'qrels' and r.row_id = q.judgment_id where status <> 'empty' group by 1, 2, 3),
      seen as (select build_id, count(*) n, sum(absent)::bigint a from keys group by 1)
      select build_id, n_judged_docs_missing::bigint as n_claimed_missing, coalesce(n, 0) as n_judged,
        coalesce(a, 0) as n_observed_missing, n_judged_docs_missing <> coalesce(a, 0) as refuted
      from metrics left join seen using (build_id)""",
}
