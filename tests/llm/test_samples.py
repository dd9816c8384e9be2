import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbascope.llm import queries, reservoir, stable_sample
from verbascope.operators.sampling import sorted_digest
from verbascope.plans.store import finished


@pytest.mark.parametrize("buffer", [1, 3, 10])
def test_geometric_file_is_uniform(buffer, tmp_path):
    size, n, runs = 10, 60, 3000
    hits, together = np.zeros(n), 0
    for seed in range(runs):
        own = reservoir.GeometricFile(size, buffer, np.random.default_rng(seed), reservoir.MemorySegments())
        for start in range(0, n, 25):
            part = range(start, min(n, start + 25))
            for i in own.accept(len(part)):
                own.add(part[i])
        got = own.records()
        assert len(got) == len(set(got)) == size and own.seen == n
        hits[got] += 1
        together += 0 in got and n - 1 in got
    expected = runs * size / n
    assert ((hits - expected) ** 2 / (expected * (1 - size / n))).sum() < n + 5 * (2 * n) ** 0.5
    pairs = runs * size * (size - 1) / (n * (n - 1))
    assert abs(together - pairs) < 5 * pairs**0.5


def test_geometric_file_in_a_folder(tmp_path):
    segments = reservoir.FolderSegments(f"file://{tmp_path}", "0-0-x", least=3)
    own = reservoir.GeometricFile(40, 16, np.random.default_rng(1), segments)
    for i in own.accept(500):
        own.add((i, "text"))
    own.flush()
    sizes = [[alive for _, alive in run] for run in own.runs]
    assert sum(map(sum, sizes)) == 40 and all(run[0] >= run[-1] for run in sizes)
    kept = [s for run in own.runs for s, _ in run]
    files = list((tmp_path / "0-0-x").iterdir())
    assert len(files) == sum(isinstance(s, str) for s in kept) > 1 and any(isinstance(s, list) for s in kept)
    assert segments.written > len(files)  # segments of older runs were given up
    assert len({i for i, _ in own.records()}) == 40 and not list((tmp_path / "0-0-x").iterdir())
    segments.close()
    assert not list(tmp_path.iterdir())


def test_small_and_invalid_sizes():
    own = reservoir.GeometricFile(5, 100, np.random.default_rng(0), reservoir.MemorySegments())
    for i in own.accept(3):
        own.add(i)
    assert sorted(own.records()) == [0, 1, 2]
    with pytest.raises(ValueError):
        reservoir.GeometricFile(0, 1, np.random.default_rng(0), reservoir.MemorySegments())


def test_hypergeometric_shares():
    assert reservoir.hypergeometric_shares([3, 4], 10, random.Random(0)) == [3, 4]
    total = np.zeros(3)
    for seed in range(2000):
        shares = reservoir.hypergeometric_shares([10, 30, 60], 20, random.Random(seed))
        assert sum(shares) == 20 and shares[0] <= 10
        total += shares
    assert np.allclose(total / 2000, [2, 6, 12], atol=0.2)
    assert sum(reservoir.hypergeometric_shares([10**12, 10**12], 5, random.Random(0))) == 5


def test_geometric_file_in_a_folder_is_uniform(tmp_path):
    size, n, runs = 12, 48, 400
    hits = np.zeros(n)
    segments = reservoir.FolderSegments(f"file://{tmp_path}", "own", least=1)
    for seed in range(runs):
        own = reservoir.GeometricFile(size, 4, np.random.default_rng(seed), segments)
        for i in own.accept(n):
            own.add(i)
        hits[own.records()] += 1
    segments.close()
    expected = runs * size / n
    assert ((hits - expected) ** 2 / (expected * (1 - size / n))).sum() < n + 5 * (2 * n) ** 0.5


@pytest.mark.parametrize("folder", [False, True])
def test_fixed_size_sample(spark, tmp_path, folder):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "x").when(F.col("id") < 50, "y").otherwise("z").alias("lang"), F.col("id").alias("rec_id"), F.lit(1).alias("shard"), F.lit(2).alias("place"))
    df = df.unionByName(spark.createDataFrame([(None, 1, 1, 1), ("x", None, 1, 1)], "lang string, rec_id bigint, shard int, place int")).repartition(5)
    got = reservoir.fixed_size_sample(df, "lang", "rec_id", 60, 3, 16, f"file://{tmp_path}" if folder else None).collect()
    by = {x: [r.rec_id for r in got if r.lang == x] for x in "xyz"}
    assert {x: len(set(v)) for x, v in by.items()} == {"x": 60, "y": 33, "z": 60} and sum(map(len, by.values())) == len(got)
    assert all(i % 3 == 0 for i in by["x"]) and all(i % 3 and i >= 50 for i in by["z"])
    assert reservoir.fixed_size_sample(df.limit(0), "lang", "rec_id", 60).count() == 0
    again = reservoir.fixed_size_sample(df.repartition(9).orderBy(F.desc("rec_id")), "lang", "rec_id", 60, 3, 16).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert not list(tmp_path.iterdir())  # no segment is left


def test_sample_over_partitions_is_uniform(spark):
    df = spark.range(90).select(F.lit("x").alias("lang"), F.col("id").alias("rec_id")).repartitionByRange(3, "rec_id").where("rec_id < 20 or rec_id > 25").cache()
    hits = np.zeros(90)
    for seed in range(40):
        hits[[r.rec_id for r in reservoir.fixed_size_sample(df, "lang", "rec_id", 42, seed, 8).collect()]] += 1
    there = np.r_[hits[:20], hits[26:]]
    assert hits[20:26].sum() == 0 and there.sum() == 40 * 42 and there.min() >= 7 and there.max() <= 33


def test_stable_sample(spark):
    salts = spark.createDataFrame([("en", 1), ("yo", 1), ("sw", None)], "lang string, salt bigint")
    rules = lambda low: salts.select("lang", stable_sample.threshold(F.when(F.col("lang") == "yo", low).otherwise(0.3)).alias("threshold"))
    keys = spark.range(3000).select(F.element_at(F.array(*map(F.lit, ("en", "yo"))), (F.col("id") % 2 + 1).cast("int")).alias("lang"), F.concat(F.lit("k"), "id").alias("docid"), F.lit("clash").alias("salt"))
    few, many = keys.where("docid < 'k2'"), keys.unionByName(spark.createDataFrame([(None, "k", ""), ("en", None, ""), ("zz", "k", "")], "lang string, docid string, salt string"))
    picked = lambda df, low: {(r.lang, r.docid) for r in stable_sample.stable_sample(df, "lang", "docid", salts.na.fill(0), rules(low)).collect()}
    first, later = picked(few, 0.1), picked(many.repartition(7), 0.4)
    assert first < later and picked(few.repartition(3), 0.1) == first
    assert abs(sum(x == "en" for x, _ in later) - 450) < 90 and abs(sum(x == "yo" for x, _ in later) - 600) < 90


def test_fingerprints(spark):
    rows = [("a", "1#2"), ("a", "1#10"), ("b", "ü"), (None, "x"), ("c", None)]
    df = spark.createDataFrame(rows, "g string, k string")
    got = {r.g: (r.n_keys, r.sha256) for r in sorted_digest(df.repartition(3), "g", "k").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {"a": (2, sha("1#10\n1#2")), "b": (1, sha("ü"))}
    own = stable_sample.fingerprint(df.where("k is not null"), ["g"], "k")
    assert own.collect() and sorted(map(tuple, own.collect()), key=str) == sorted(map(tuple, stable_sample.fingerprint(df.where("k is not null").repartition(4), ["g"], "k").collect()), key=str)
    assert {r.g: r.fingerprint for r in own.collect()}["b"] == sha("ü")
    assert sorted_digest(df.limit(0), "g", "k").count() == 0


def test_registered_sample_uses_files_in_the_shared_folder(spark, monkeypatch):
    from conftest import SMALL

    own = reservoir.shard_samples

    def watched(*x):
        given.append(x)
        return own(*x)

    given = []
    monkeypatch.setattr(reservoir, "shard_samples", watched)
    monkeypatch.setattr(queries, "SAMPLE_SIZE", 20)
    monkeypatch.setattr(queries, "SAMPLE_BUFFER", 8)
    assert queries.p1_sample(spark, SMALL).count() > 0
    assert given[0][6].startswith(spark.conf.get("spark.checkpoint.dir"))


def test_sample_is_repeatable_and_never_falls_back(spark, tmp_path):
    df = spark.range(3000).selectExpr("'x' lang", "id rec_id")
    sample = lambda d: sorted(r.rec_id for r in reservoir.fixed_size_sample(d, "lang", "rec_id", 500, 1, 100, f"file://{tmp_path}", 2).collect())
    assert sample(df) == sample(df.union(df.limit(0)).repartition(3)) and len(sample(df)) == 500
    with pytest.raises(Exception):  # a folder nobody can write to is an error, no silent fallback to memory
        reservoir.fixed_size_sample(df, "lang", "rec_id", 500, 1, 100, "file:///proc/none", 2)


def test_rules_are_kept(spark, tmp_path):
    folder = f"file://{tmp_path}/rules"
    rules = lambda *rows: {tuple(r) for r in stable_sample.rules_in_force(spark.createDataFrame(rows, "lang string, salt bigint, threshold bigint"), "lang", folder).collect()}
    assert rules(("en", 1, 10), ("yo", None, 5), (None, 3, 5)) == {("en", 1, 10)}
    assert rules(("en", 2, 5), ("yo", 7, 5)) == {("en", 1, 10), ("yo", 7, 5)}  # another seed and a lower rate change nothing, a seed that is filled in is new
    assert rules(("en", 9, 30)) == {("en", 1, 30), ("yo", 7, 5)}
    n = len(finished(spark, folder))
    assert rules(("en", 9, 20)) == {("en", 1, 30), ("yo", 7, 5)} and len(finished(spark, folder)) == n == 3
    (tmp_path / "rules" / "v00000009").mkdir()  # a version that was never finished
    assert rules() == {("en", 1, 30), ("yo", 7, 5)}


def test_registered_sample_stays_as_builds_arrive(spark, tmp_path, monkeypatch):
    """An earlier-dated build, a seed that is filled in, and lower rates leave every earlier record in."""
    from conftest import SMALL

    d, own = f"{tmp_path}/tables", lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    metrics, corpus = own("metrics"), own("subcorpus")
    seeded = metrics.withColumn("seed", F.when(F.col("lang") == "te", None).otherwise(F.col("seed")))
    write = lambda m, c: (m.write.mode("overwrite").parquet(f"{d}/metrics.parquet"), c.write.mode("overwrite").parquet(f"{d}/subcorpus.parquet"))
    sample = lambda: {(r.lang, r.docid) for r in queries.p4_sample(spark, d).collect()}
    monkeypatch.setattr(queries, "STABLE_RATE", 0.4)
    write(seeded, corpus.where("rec_id % 3 > 0"))
    first = sample()
    assert first and not any(lang == "te" for lang, _ in first)
    early = metrics.select(*(F.concat(F.lit("early-"), "build_id").alias(c) if c == "build_id" else F.expr("built_utc - interval 9 years").alias(c) if c == "built_utc" else (F.col(c) + 12345).alias(c) if c == "seed" else c for c in metrics.columns))
    spark.catalog.clearCache()
    write(metrics.unionByName(early), corpus)
    monkeypatch.setattr(queries, "STABLE_RATE", 0.1)
    later = sample()
    assert first < later and any(lang == "te" for lang, _ in later)
