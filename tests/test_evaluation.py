import math
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from verbascope.operators import evaluation as V
from verbascope.operators import failures as L
from verbascope.operators import statistics as S
from verbascope.queries import evaluation as E
from verbascope.sources import collection as C

RUN, QRELS, TOPICS = "lang string, qid string, docid string, rank int", "lang string, qid string, docid string, rel int", "lang string, qid string"


#: By query: the ranking, the grades, and the scores worked out by hand (nDCG@10, Recall@100, MRR@10, positives, unjudged@10, unjudged@100).
BY_HAND = {
    # gains 0, 1, 0; ideal 1, 1: (1 / log2 3) / (1 + 1 / log2 3)
    "two of one": (["d1", "d2", "d3"], {"d2": 1, "d9": 1, "d3": 0}, (0.386853, 0.5, 0.5, 2, 1, 1)),
    # gains 1, 2, 3 against 3, 2, 1: 3.761860 / 4.761860
    "upside down": (["c", "b", "a"], {"a": 3, "b": 2, "c": 1}, (0.789998, 1.0, 1.0, 3, 0, 0)),
    # found at rank 11: too late for all but recall
    "late": ([f"x{i}" for i in range(10)] + ["hit"], {"hit": 1}, (0.0, 1.0, 0.0, 1, 10, 10)),
    # judged, but nothing is positive
    "no positive": (["a", "b"], {"a": 0, "b": -1}, (0.0, 0.0, 0.0, 0, 0, 0)),
    "no ranking": ([], {"a": 1}, (0.0, 0.0, 0.0, 1, 0, 0)),
    # 20 positives of equal grade: ten fill the ideal; 12 are retrieved
    "more than ten": ([f"p{i}" for i in range(12)], {f"p{i}": 1 for i in range(20)}, (1.0, 0.6, 1.0, 20, 0, 0)),
    # ranks beyond 100 count for nothing: 101 documents, the last one positive
    "beyond depth": ([f"u{i}" for i in range(100)] + ["hit"], {"hit": 2}, (0.0, 0.0, 0.0, 1, 10, 100)),
    # first at rank 4: 1 / log2 5 over 1
    "fourth": (["a", "b", "c", "hit"], {"hit": 1, "a": 0}, (0.430677, 1.0, 0.25, 1, 2, 2)),
}


def test_evaluate_by_hand(spark):
    df = lambda rows, schema: spark.createDataFrame([("en", *r) for r in rows], schema).repartition(3)
    run = df([(q, d, i) for q, (ranked, _, _) in BY_HAND.items() for i, d in enumerate(ranked, 1)], RUN)
    judged = df([(q, d, x) for q, (_, rel, _) in BY_HAND.items() for d, x in rel.items()], QRELS)
    got = {r.qid: tuple(r)[2:] for r in V.evaluate(run, judged, df([(q,) for q in BY_HAND], TOPICS)).collect()}
    assert got.keys() == BY_HAND.keys()
    for q, (_, _, expected) in BY_HAND.items():
        assert got[q] == pytest.approx(expected, abs=2e-6), q


def test_empty_evaluation(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    topics = spark.createDataFrame([("en", "q")], TOPICS)
    assert tuple(V.evaluate(none(RUN), none(QRELS), topics).first())[2:] == (0, 0, 0, 0, 0, 0)
    assert V.evaluate(none(RUN), none(QRELS), none(TOPICS)).count() == 0


@pytest.mark.parametrize(("values", "expected"), [((0.0, 0.0, 0.0), "total_miss"), ((0.0, 0.5, 0.0), "deep_miss"), ((0.3, 1.0, 0.5), "weak_rank"), ((0.9, 1.0, 1.0), "rank1"), ((None, None, None), "total_miss")])
def test_categories(spark, values, expected):
    df = spark.createDataFrame([values], "ndcg10 double, recall100 double, mrr10 double")
    assert L.with_category(df).first().category == expected


def test_transitions(spark):
    rows = [("a", "en", "1", 0.0, 0.0, 0.0), ("b", "en", "1", 0.5, 1.0, 0.5), ("a", "en", "2", 0.5, 1.0, 1.0), ("b", "en", "2", 0.0, 0.5, 0.0), ("a", "en", "3", 0.5, 1.0, 1.0), ("b", "en", "3", 0.5, 1.0, 1.0), ("a", "en", "4", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sys_name string, lang string, qid string, ndcg10 double, recall100 double, mrr10 double").selectExpr("*", "1 n_positives", "cast(null as int) unjudged10", "2 unjudged100")
    moves = L.transitions(L.paired(df, "a", "b"))
    got = L.rescued_and_broken(moves).first()
    assert (got.n, got.n_rescued, got.n_broken, got.net_rate) == (3, 1, 1, 0.0)
    assert L.exposure(L.paired(df, "a", "b")).count() == 0 and L.pair_coverage(df, "a", "b").first().n_first_only == 1


#: Published differences in nDCG@10 with their bootstrap standard errors, by language.
PUBLISHED = [("ar", 0.230936, 0.016754), ("bn", 0.209628, 0.01933), ("de", 0.260408, 0.020075), ("en", 0.216303, 0.017281), ("es", 0.225456, 0.016983), ("fa", 0.234037, 0.020754), ("fi", 0.146593, 0.018529), ("fr", 0.296485, 0.018761), ("hi", 0.172033, 0.021768), ("id", 0.177105, 0.019503), ("ja", 0.325647, 0.019937), ("ko", 0.335496, 0.025199), ("ru", 0.280285, 0.019584), ("sw", 0.259415, 0.022798), ("te", 0.287312, 0.022637), ("th", 0.296366, 0.020923), ("yo", -0.06761, 0.046373), ("zh", 0.519057, 0.021414)]


@pytest.mark.parametrize(("without", "k", "pooled", "low", "high", "tau2", "i2"), [((), 18, 0.2476, 0.2069, 0.2883, 0.00728, 0.946), (("yo",), 17, 0.2627, 0.2240, 0.3013, 0.0062, 0.940), (("yo", "zh"), 16, 0.2464, 0.2201, 0.2726, 0.00247, 0.864), (("yo", "zh", "ko", "ja"), 14, 0.2348, 0.2101, 0.2594, 0.00183, 0.829)])
def test_random_effects_gives_published_values(spark, without, k, pooled, low, high, tau2, i2):
    df = spark.createDataFrame([("x", y, s) for lang, y, s in PUBLISHED if lang not in without], "g string, y double, se double")
    got = S.random_effects(df, ["g"]).first()
    assert (got.k, got.df) == (k, k - 1)
    assert (got.pooled_effect, got.ci95_low, got.ci95_high) == pytest.approx((pooled, low, high), abs=1e-4)
    assert got.tau2 == pytest.approx(tau2, abs=6e-5) and got.i2 == pytest.approx(i2, abs=1e-3)


def test_random_effects_without_spread(spark):
    got = S.random_effects(spark.createDataFrame([("x", 0.2, 0.1)] * 5 + [("y", 1.0, 0.0)], "g string, y double, se double"), ["g"]).collect()
    x, y = sorted(got, key=lambda r: r.g)
    assert (x.tau2, x.i2, x.pooled_effect) == (0, 0, 0.2) and x.se == pytest.approx(0.1 / 5**0.5, abs=1e-6) and (y.k, y.pooled_effect) == (1, 1.0)


def test_bootstrap(spark):
    rng = random.Random(1)
    rows = [("en", f"q{i}", round(rng.gauss(0.1, 0.5), 6)) for i in range(119)] + [("de", "q", None)]
    df = spark.createDataFrame(rows, "lang string, qid string, diff double")
    values = [d for *_, d in rows if d is not None]
    spread = (sum((d - sum(values) / 119) ** 2 for d in values) / 118) ** 0.5 / 119**0.5
    got = S.paired_bootstrap(df.repartition(5), ["lang"], ["qid"]).collect()
    assert len(got) == 1 and got[0].n == 119 and got[0].boot_se == pytest.approx(spread, rel=0.03)
    assert got[0].ci95_high - got[0].ci95_low == pytest.approx(2 * 1.96 * spread, rel=0.05) and got[0].ci95_low < got[0].mean_diff < got[0].ci95_high
    assert tuple(S.paired_bootstrap(df.repartition(5), ["lang"], ["qid"], 50).first()) == tuple(S.paired_bootstrap(df.repartition(2), ["lang"], ["qid"], 50).first())
    means = S.bootstrap_means(df, ["lang"], ["qid"], 10_000, 1).agg(F.countDistinct("b"), F.min("b"), F.max("b")).first()
    assert tuple(means) == (10_000, 1, 10_000)
    assert S.paired_bootstrap(df.limit(0), ["lang"], ["qid"]).count() == 0


def test_bootstrap_weights_have_the_poisson_law():
    share = [(b - a) / 65536 for a, b in zip([0, *S.WEIGHT_STEPS], [*S.WEIGHT_STEPS, 65536])]
    assert share[:5] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=4e-5) and sum(k * x for k, x in enumerate(share)) == pytest.approx(1, abs=3e-4)


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (3.0, 4.0), (None, 1.0)], "x double, y double")
    got = S.rank_correlations(df, [], ["x", "y"]).first()
    assert got.n == 4 and got.rho_x_y == pytest.approx(8 / 9)
    low, high = S.fisher_interval(F.lit(0.511), F.lit(17))
    interval = spark.range(1).select(low, high).first()
    assert tuple(interval) == pytest.approx((0.039, 0.796), abs=2e-3)
    assert spark.range(1).select(S.partial(F.lit(0.5), F.lit(0.0), F.lit(0.3))).first()[0] == pytest.approx(0.5 / math.sqrt(0.91))
    assert spark.range(1).select(S.detectable(F.lit(3))).first()[0] is None


def test_registered_scores_rank_every_passage(spark):
    sizes = {r.lang: min(r["count"], 100) for r in C.passages(spark, SMALL).groupBy("lang").count().collect()}
    asked = {(r.lang, r.qid) for r in C.topics(spark, SMALL).collect() if r.lang in sizes}
    got = {(r.lang, r.qid): r["count"] for r in E.QUERIES["w01_ranks"](spark, SMALL).groupBy("lang", "qid").count().collect()}
    assert got == {(lang, qid): sizes[lang] for lang, qid in asked} and max(got.values()) > 24
    assert max(r.unjudged100 for r in E.QUERIES["v05_unjudged"](spark, SMALL).collect()) > 10


def test_every_resample_is_listed(spark):
    from verbascope.queries import queries

    drawn = queries()["r04_resamples_full"](spark, SMALL).groupBy("lang").agg(F.countDistinct("b").alias("n"), F.max("b").alias("last")).collect()
    assert drawn and {(r.n, r.last) for r in drawn} == {(10_000, 10_000)}


def test_draws_are_hashes_spread_over_tasks(spark, monkeypatch):
    """Every draw is the hash of seed, language, resample and draw, also of long names, and the draws of one language are many tasks' work."""
    import hashlib

    from verbascope.operators import statistics

    monkeypatch.setattr(statistics, "HASHED_PAIRS", 64)
    monkeypatch.setattr(statistics, "PIECE_DRAWS", 500)
    sizes = [("en", 120), ("ไทย", 9), ("x" * 60, 3)]
    drawn = statistics.draws(spark.createDataFrame(sizes, "lang string, n bigint"), 101, 7)
    got = {(r.lang, r.b, r.draw): r.i for r in drawn.collect()}
    number = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    assert got == {(lang, b, k): number(7, lang, b, k) % n for lang, n in sizes for b in range(1, 102) for k in range(1, n + 1)} and drawn.count() == len(got)
    assert drawn.where("lang = 'en'").select(F.spark_partition_id()).distinct().count() > 4


def test_gain_ranks_as_deep_as_its_measure(spark, monkeypatch):
    """The comparison of tokenisers ranks ten documents a query, and has the nDCG@10 of rankings of a hundred."""
    from verbascope.operators import bm25

    depths, run = [], bm25.run_bm25
    monkeypatch.setattr(bm25, "run_bm25", lambda *x: depths.append(x[3] if len(x) > 3 else 100) or run(*x))
    got = {(r.lang, r.qid): r.ndcg10 for r in E._swept(spark, SMALL, ["char4"]).collect()}
    assert depths == [10]
    assert got == {(r.lang, r.qid): r.ndcg10 for r in E.QUERIES["v02_ndcg"](spark, SMALL).collect()} and got
