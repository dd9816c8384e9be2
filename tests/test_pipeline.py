import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from verbascope import pipeline as P
from verbascope.plans import store as ST


def test_store_goes_on_where_it_stopped(spark, tmp_path):
    own, asked = ST.Store(spark, f"file://{tmp_path}/s"), []

    def make(left):
        keys = sorted(r.k for r in left.collect())
        asked.append(keys)
        return spark.createDataFrame([(k, len(k)) for k in keys], "k string, n int")

    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert own.read("x") is None
    assert own.extend("x", keys("a", "b", "b", None), ["k"], make).count() == 2
    assert own.extend("x", keys("a", "b"), ["k"], make).count() == 2 and asked == [["a", "b"]]

    def broken(left):
        return make(left).withColumn("n", F.raise_error(F.lit("stopped")).cast("int"))

    with pytest.raises(Exception):
        own.extend("x", keys("a", "c"), ["k"], broken)
    assert {r.k for r in own.read("x").collect()} == {"a", "b"}
    assert {r.k for r in own.extend("x", keys("a", "c"), ["k"], make).collect()} == {"a", "b", "c"} and asked[-1] == ["c"]
    got = own.replace("x", spark.createDataFrame([("a", 7)], "k string, n int"), ["k"])
    assert {(r.k, r.n) for r in got.collect()} == {("a", 7), ("b", 1), ("c", 1)} and len(ST.finished(spark, f"file://{tmp_path}/s/x")) == 1


def test_pipeline_makes_only_what_is_lacking(spark, tmp_path):
    run = lambda languages=None: P.Pipeline(spark, SMALL, f"file://{tmp_path}/p", languages, target=30)
    first = run(["en", "sw"])
    for step in P.STEPS:
        getattr(first, step)()
    made = {name: first.store.read(name).select("lang", "made_utc").distinct().collect() for name in ("corpus", "run-char4", "per_query-word", "fertility")}
    assert all({r.lang for r in rows} == {"en", "sw"} for rows in made.values())
    assert first.store.read("manifest").where("n_actual < least(n_target, 30)").count() <= 1
    again = run()
    for step in P.STEPS:
        getattr(again, step)()
    for name, rows in made.items():
        own = again.store.read(name)
        assert {r.lang for r in own.select("lang").distinct().collect()} > {"en", "sw"}
        assert {tuple(r) for r in rows} <= {tuple(r) for r in own.select("lang", "made_utc").distinct().collect()}
        assert own.count() == own.dropDuplicates([c for c in own.columns if c != "made_utc"]).count()
    parts = len(ST.finished(spark, f"file://{tmp_path}/p/run-char4"))
    again.retrieve()
    assert parts == len(ST.finished(spark, f"file://{tmp_path}/p/run-char4")) == 2
    pooled = again.store.read("pooled").collect()
    assert len(pooled) == 1 and pooled[0].k == again.store.read("effects").count() > 2


def test_command_line(spark, tmp_path, capsys):
    P.main(["build", "fertility", "--tables", SMALL, "--store", f"file://{tmp_path}/c", "--languages", "sw", "--target", "10"])
    assert "build: 1 rows" in capsys.readouterr().out
