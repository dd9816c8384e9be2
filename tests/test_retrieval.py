import math
import random
import unicodedata

import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from verbascope.functions import text as X
from verbascope.operators import bm25, dense

SAMPLES = ["", " ", "Straße", "ﬁne", "①", "İx", "a b\u001cc", "don't, stop!", "ওপেন সোর্স", "తెలుగు భాష", "हिन्दी", "ภาษาไทย ดี", "x" * 5000]


def normal(t):
    return regex.sub(r"[\p{P}\p{S}]", " ", unicodedata.normalize("NFKC", t).casefold())


def grams(t, n):
    return [w[i : i + n] for w in t.split() for i in range(max(1, len(w) - n + 1))]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*SAMPLES, None])], "i int, t string")


def test_normalise_exact(samples):
    got = {r.i: r.x for r in samples.select("i", X.normalise_exact(F.col("t")).alias("x")).collect()}
    assert got == {i: normal(t) for i, t in enumerate(SAMPLES)} | {len(SAMPLES): None}


def test_marks_survive(samples):
    got = {r.i: r.x for r in samples.select("i", F.size(X.words(X.normalise(F.col("t")))).alias("x")).collect()}
    assert got[SAMPLES.index("ওপেন সোর্স")] == got[SAMPLES.index("తెలుగు భాష")] == 2


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_tokenisers(samples, n):
    name = f"char{n}"
    got = {r.i: r.x for r in samples.select("i", X.TOKENISERS[name](F.col("t")).alias("x")).collect()}
    assert got == {i: grams(t or "", n) for i, t in enumerate([*SAMPLES, None])}
    assert all(X.python_tokeniser(name)(t) == got[i] for i, t in enumerate(SAMPLES))
    words = {r.i: r.x for r in samples.select("i", X.words(F.col("t")).alias("x")).collect()}
    assert all(words[i] == t.split() for i, t in enumerate(SAMPLES))


def test_other_text_functions(spark):
    sizes = spark.createDataFrame([("905M",), ("2.5G",), ("unknown",), (None,)], "s string")
    assert [r[0] for r in sizes.select(X.size_in_mb(F.col("s"))).collect()] == [905.0, 2560.0, None, None]
    shown = spark.range(1).select(X.renderings(F.lit(-0.26270))).first()[0]
    assert {"-0.2627", "0.2627", "0.263", "0.26"} <= set(shown)


def brute(docs, queries, n, depth):
    """Okapi over (docid, tokens) by definition."""
    bags = {d: t for d, t in docs}
    size, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {}
    for t in bags.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    raw = {x: math.log(size - f + 0.5) - math.log(f + 0.5) for x, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0
    out = {}
    for q, terms in queries:
        scores = {d: sum((raw[x] if raw[x] >= 0 else floor) * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for x in terms if x in t) for d, t in bags.items()}
        out[q] = sorted(((round(s + 1e-9, 6), d) for d, s in scores.items()), key=lambda p: (-p[0], p[1]))[:depth]
    return out


@pytest.mark.parametrize(("block", "size"), [(10**6, 10**6), (3, 10**6), (10**6, 7)])
def test_bm25_against_brute_force(spark, block, size, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_TERMS", block)
    for name in ("BATCH_SCORES", "BATCH_PRODUCTS", "COUNTED_TERMS", "ROW_TERMS"):
        monkeypatch.setattr(bm25, name, size)
    rng = random.Random(3)
    vocabulary = "river court striker the of a kernel wage".split()
    docs = [("en", f"d{i:03}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(150)] + [("de", "d000", "fluss"), ("de", "d001", None)]
    queries = [("en", "q1", "river river court"), ("en", "q2", "unknown"), ("en", "q3", ""), ("de", "q1", "fluss"), ("fr", "q1", "river")]
    corpus, topics = spark.createDataFrame(docs, "lang string, docid string, norm string").repartition(4), spark.createDataFrame(queries, "lang string, qid string, norm string")
    got = {}
    for r in bm25.run_bm25(corpus, topics, "word", 100).orderBy("lang", "qid", "rank").collect():
        got.setdefault((r.lang, r.qid), []).append((r.score, r.docid))
    for lang in ("en", "de"):
        expected = brute([(d, (t or "").split()) for x, d, t in docs if x == lang], [(q, t.split()) for x, q, t in queries if x == lang], 0, 100)
        for q, rows in expected.items():
            assert [d for _, d in got[lang, q]] == [d for _, d in rows]
            assert [s for s, _ in got[lang, q]] == pytest.approx([s for s, _ in rows], abs=2e-6)
    assert ("fr", "q1") not in got
    tokens = X.words(F.col("norm"))
    joined = bm25.ranked(bm25.scored(corpus, topics, tokens, tokens), 100)
    again = {(r.lang, r.qid, r.docid): r.score for r in bm25.padded(joined, topics, corpus, 100).collect()}
    assert again == pytest.approx({(*k, d): s for k, rows in got.items() for s, d in rows}, abs=2e-6)
    assert bm25.run_bm25(corpus.limit(0), topics, "word", 5).count() == 0 and bm25.run_bm25(corpus, topics.limit(0), "word", 5).count() == 0


def test_documents_are_encoded_once_for_many_queries(spark, monkeypatch):
    """Queries of few distinct terms, however many they are, take one pass over the documents; parts of a language's queries give whole rankings."""
    passes, encoded = [], bm25._encoded
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 50)
    monkeypatch.setattr(bm25, "TASK_QUERIES", 7, raising=False)
    monkeypatch.setattr(bm25, "CHUNK_DOCUMENTS", 20, raising=False)
    monkeypatch.setattr(bm25, "_encoded", lambda *x, **y: passes.append(1) or encoded(*x, **y))
    rng = random.Random(8)
    vocabulary = "river court striker kernel wage delta".split()
    docs = [("en", f"d{i:03}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(130)]
    queries = [("en", f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 3)))) for i in range(60)]
    corpus, topics = spark.createDataFrame(docs, "lang string, docid string, norm string").repartition(3), spark.createDataFrame(queries, "lang string, qid string, norm string")
    got = {}
    for r in sorted(bm25.run_bm25(corpus, topics, "word", 20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.qid, []).append(r.docid)
    expected = brute([(d, t.split()) for _, d, t in docs], [(q, t.split()) for _, q, t in queries], 0, 20)
    assert got == {q: [d for _, d in rows] for q, rows in expected.items()} and len(passes) == 1


def test_both_tokenisers_know_the_same_blanks(spark):
    """Words of Catalyst and of Python agree over every code point."""
    text = [f"a{chr(i)}b" for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    df = spark.createDataFrame(pd.DataFrame({"t": text}))
    got = df.select("t", F.size(X.words(F.col("t"))).alias("n")).toPandas()
    assert len(got) == len(text) and all(n == len(t.split()) for t, n in zip(got["t"], got["n"]))


def test_many_queries_of_one_language_stay_small(monkeypatch):
    """20,000 queries of one language over batches of documents: the arrays of a worker stay below 1 GB, and scores are right."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    n_queries, n_terms, n_documents = 20_000, 15_000, 600
    terms = (rng.zipf(1.3, (n_queries, 16)) - 1) % n_terms
    rows = [(q, int(t)) for q in range(n_queries) for t in dict.fromkeys(terms[q].tolist())]
    order = sorted(range(len(rows)), key=lambda i: rows[i][1])
    queries = np.array([rows[i][0] for i in order])
    weights = 1.0 + rng.random(len(rows))
    starts = np.concatenate([[0], np.cumsum(np.bincount([t for _, t in rows], minlength=n_terms))])
    documents = [dict.fromkeys(((rng.zipf(1.3, 80) - 1) % n_terms).tolist(), 1) for _ in range(n_documents)]
    tracemalloc.start()
    own = bm25._Queries([str(q) for q in range(n_queries)], starts, queries, weights, 80.0, 100)
    for i in range(0, n_documents, 200):
        part = documents[i : i + 200]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        own.add([f"{j:05}" for j in range(i, i + len(part))], np.full(len(part), 80), np.array([t for x in part for t in x]), np.ones(ends[-1], int), ends)
    q, d, s = own.best.settle()
    assert tracemalloc.get_traced_memory()[1] < 1_000_000_000
    tracemalloc.stop()
    for query in (0, 7, 19_999):
        weight = {int(t): w for t in range(n_terms) for k, w in zip(queries[starts[t] : starts[t + 1]], weights[starts[t] : starts[t + 1]]) if k == query}
        expected = sorted(((-round(sum(w for t, w in weight.items() if t in x) * 2.5 / 2.5 + 1e-9, 6), j) for j, x in enumerate(documents) if weight.keys() & x.keys()))[:100]
        assert [int(own.docids[j]) for j in d[q == query]] == [j for _, j in expected]
        assert s[q == query] == pytest.approx([-x for x, _ in expected], abs=2e-6)


def test_cosine_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [(90, [0.0] * 8), (91, None)]
    vectors += [(92, vectors[3][1])]
    df = spark.createDataFrame(vectors, "docid bigint, vec array<float>").repartition(3)
    asked = df.where("docid % 9 = 0").withColumnRenamed("docid", "qid")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / max(1e-12, math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))
    for limit in (1 << 25, 200):
        monkeypatch.setattr(dense, "BLOCK_BYTES", limit)
        got = {}
        for r in dense.cosine_top(asked, df, 10).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.score)
        for q, v in vectors:
            if q % 9 == 0 and v:
                assert got[q] == pytest.approx(sorted((cosine(v, w) for d, w in vectors if w and d != q), reverse=True)[:10], abs=1e-5)
    assert dense.cosine_top(asked.limit(0), df, 10).count() == 0 and dense.cosine_top(asked, df.limit(0), 10).count() == 0


def test_encoder_surface(spark):
    df = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(60)] + [(60, None)], "id int, text string")
    own = dense.hashing_encoder(16)
    got = {r.id: r.vec for r in dense.encode(df, ["id"], "text", own, "query: ").collect()}
    assert len(got) == 61 and all(got[i] == pytest.approx(own(["query: " + "word " * (i % 7)])[0]) for i in range(60))
    left = dense.remaining(df, df.where("id < 50"), ["id"])
    assert left.count() == 11
    pooled = spark.range(1).select(dense.masked_mean(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1.0), F.lit(0.0)))).first()[0]
    assert pooled == [1.0, 2.0]
    assert spark.range(1).select(dense.unit(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_pooling_encoder_against_each_text_alone(spark):
    import numpy as np

    from verbascope.functions.subwords import tokeniser

    texts = ["one two", "", "a much longer text than the others " * 60, "ภาษาไทย"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string").repartition(2)
    got = {r.id: r.vec for r in dense.encode(df, ["id"], "text", dense.pooling_encoder("byte_bpe_50k", width=8), "query: ", batch_size=2).collect()}
    for i, t in enumerate([*texts, ""]):
        ids = tokeniser("byte_bpe_50k")("query: " + t)[:256]
        mean = dense.token_vectors(50257, 8, 0)[ids].mean(0)
        assert got[i] == pytest.approx((mean / np.linalg.norm(mean)).tolist(), abs=1e-6)
    assert dense.pooling_encoder("byte_bpe_50k", width=4)([""]) == [[0.0] * 4]
