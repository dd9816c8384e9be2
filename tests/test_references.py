import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from verbascope.operators import references as R

START = datetime(2025, 1, 1)
EVENT = "target string, lang string, key string, at timestamp, present int"
REF = "tab string, row_id bigint, target string, lang string, key string, at timestamp"


def status(ref, events):
    _, _, target, lang, key, at = ref
    if lang is None or key is None:
        return R.EMPTY
    if at is None:
        return R.UNDATED
    own = sorted((e[3], e[4]) for e in events if e[:3] == (target, lang, key))
    before = [p for t, p in own if t <= at]
    if before and before[-1]:
        return R.FOUND
    there = [t for t, p in own if p]
    return R.MISSING if not there else R.LATE if min(there) > at else R.DELETED


def test_against_brute_force(spark):
    rng = random.Random(5)
    minute = lambda: START + timedelta(minutes=rng.randrange(0, 7 * 1440, 30))
    key = lambda: "hot" if rng.random() < 0.4 else f"k{rng.randrange(25)}"
    events = list({("t", rng.choice(["en", "de"]), key(), minute(), int(rng.random() < 0.6)) for _ in range(500)})
    refs = [("a", i, "t", rng.choice(["en", "de", "en", None]), rng.choice([key(), key(), key(), None]), rng.choice([minute(), minute(), minute(), None])) for i in range(800)]
    refs += refs[:5] + [("a", 9001, "u", "en", "hot", START), ("a", 9002, "t", "en", "never", START)]
    own = spark.createDataFrame(refs, REF)
    got = R.resolve_references(own.repartition(6), spark.createDataFrame(events, EVENT).repartition(3))
    assert sorted((r.row_id, r.status) for r in got.collect()) == sorted((r[1], status(r, events)) for r in refs)
    report = R.orphan_report(got).collect()
    assert sum(r.n_references for r in report) == len(refs) and sum(r.n_missing + r.n_deleted + r.n_late for r in report) == R.orphans(got).count()


def test_tables_with_stray_blanks_and_clashing_columns(spark):
    passages = spark.createDataFrame([("en", " 1#1\t", START, 1), ("en", "1#2", START, 1), ("en", " ", START, 1), (None, "1#3", START, 1), ("en", "1#4", None, 1)], "lang string, docid string, received_at timestamp, present int")
    qrels = spark.createDataFrame([(1, "en", "1#1"), (2, "en", "1#2 "), (3, "en", " \t"), (4, "de", "1#1"), (5, "en", "1#3"), (6, "en", "1#4")], "id int, lang string, docid string").withColumn("at", F.lit(START)).withColumn("status", F.lit("clash")).withColumn("day", F.lit(0))
    refs = R.references(qrels, "qrels", "id", "subcorpus", "docid", "at")
    got = {r.row_id: r.status for r in R.resolve_references(refs, R.parent_events(passages, "subcorpus", "docid", "received_at", True)).collect()}
    assert got == {1: R.FOUND, 2: R.FOUND, 3: R.EMPTY, 4: R.MISSING, 5: R.MISSING, 6: R.MISSING}


def test_same_instant_and_empty_tables(spark):
    events = spark.createDataFrame([("t", "en", "a", START, 1), ("t", "en", "a", START, 0), ("t", "en", "b", START, 1), ("t", "en", "b", START + timedelta(seconds=1), 0)], EVENT)
    refs = spark.createDataFrame([("x", 1, "t", "en", "a", START), ("x", 2, "t", "en", "b", START + timedelta(seconds=1)), ("x", 3, "t", "en", "b", START - timedelta(days=9))], REF)
    assert {r.row_id: r.status for r in R.resolve_references(refs, events).collect()} == {1: R.FOUND, 2: R.DELETED, 3: R.LATE}
    assert {r.status for r in R.resolve_references(refs, events.limit(0)).collect()} == {R.MISSING}
    assert R.resolve_references(refs.limit(0), events).count() == 0
    assert R.orphan_report(R.resolve_references(refs.limit(0), events)).count() == 0


def test_claims(spark):
    resolved = spark.createDataFrame([(1, "en", "a", "found"), (2, "en", "b", "missing"), (3, "en", "b", "late"), (4, "en", None, "empty")], "row_id int, lang string, key string, status string")
    judgments = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x")], "row_id int, build_id string")
    manifest = spark.createDataFrame([("x", 2), ("y", 0), ("z", None)], "build_id string, n_judged_docs_missing int")
    got = {r.build_id: (r.n_claimed_missing, r.n_judged, r.n_observed_missing, r.refuted) for r in R.judged_claims(resolved, judgments, manifest).collect()}
    assert got == {"x": (2, 2, 1, True), "y": (0, 0, 0, False), "z": (None, 0, 0, None)}
