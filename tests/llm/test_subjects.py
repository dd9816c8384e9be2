import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbascope.llm import subjects as S

TOPICS = {
    "en": {"law": "judge court verdict appeal clause jury statute".split(), "sport": "striker medal coach league stadium relay sprint".split()},
    "zh": {"law": "法官 法院 判决 上诉 律师 起诉 法律".split(), "sport": "前锋 奖牌 教练 联赛 球场 接力 比赛".split()},
}
FRAMES = {
    "en": ["The {} was known before the {}.", "Some notes compare the {} with the {}.", "Few people linked the {} to the {}."],
    "zh": ["关于{}与{}有旧记载。", "人们再次研究{}和{}。", "{}使他走向{}。"],
}
NEUTRAL = {"en": ["The page was last revised in 1999.", "See also the notes of 1890."], "zh": ["另见以及注释。", "本页最近修订。"]}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows, labels, truth = [], [], set()
    for i in range(n):
        lang = ("en", "zh")[i % 2]
        mix = rng.choice([["law"], ["sport"], ["law", "sport"], []])
        text = []
        for _ in range(rng.randint(3, 9)):
            if mix and rng.random() < 0.8:
                subject = rng.choice(mix)
                text.append((rng.choice(FRAMES[lang]).format(*rng.sample(TOPICS[lang][subject], 2)), subject))
            else:
                text.append((rng.choice(NEUTRAL[lang]), None))
        rows.append((i, lang if i % 11 else rng.choice([None, "fr"]), (" " if lang == "en" else "").join(t for t, _ in text)))
        truth |= {(i, s) for s in mix if sum(x == s for _, x in text) > len(text) / 4}
        if i % 2 == (i // 4) % 2:
            labels += [(i, s if rng.random() > 0.05 else "Law", f"r{i % 3}") for s in mix or [None]]
    return rows, labels, truth


@pytest.fixture(scope="module")
def found(spark):
    rows, labels, truth = corpus(600)
    df = spark.createDataFrame([*rows, (9000, "en", None), (9001, "en", ""), (9002, None, "  \n"), (9003, "en", "🧪 1234 --")], "doc_id bigint, lang string, text string").withColumn("subject", F.lit("clash"))
    given = spark.createDataFrame([*labels, (None, "law", "r")], "doc_id bigint, subject string, rater string")
    return {tuple(r) for r in S.document_subjects(df, given, ["Law", "sport"]).collect()}, {(i, "Law" if s == "law" else s) for i, s in truth}


def test_accuracy(found):
    got, truth = found
    assert len(got & truth) / len(got) > 0.95 and len(got & truth) / len(truth) > 0.95


def test_no_labels_and_no_documents(spark):
    df = spark.createDataFrame(corpus(40)[0], "doc_id bigint, lang string, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject string, rater string")
    assert S.document_subjects(df, none, ["law"]).count() == 0
    assert S.document_subjects(df.limit(0), none, ["law"]).count() == 0


def test_sentences():
    text = "== Name ==\n1. [[Name]] is first.[12] Has 3.5 m (18.18 %) of it.\r\n@member3: Really?! Yes\n<p>Über <b>alles</b>.</p> 🧪\n\n"
    assert [s.strip() for s in S.sentences(text, "de")] == ["Name is first", "Has 3.5 m of it", "Really", "Yes", "Über alles"]
    assert len(S.sentences("一件。(82.63 %)二件。三件!", "zh")) == 3
    assert len(S.sentences("ห\u0e39น\u0e35บาก\u0e39ส\u0e35ม\u0e31ก พบห\u0e38บเขา ในป\u0e35 1789 ภ\u0e39เขาทำให\u0e49 (1542–1598)พบ[3] มะน\u0e39", "th")) == 4
    assert S.sentences(None, None) == S.sentences("", "en") == S.sentences(" 12 34. ", "en") == []
    assert len(S.sentences("A bird. " * 20_000, "en")) == 20_000


def test_terms():
    assert {"courts", "court", "cour"} >= set(S.terms("Courts")) >= {"court"}
    assert "法院" in S.terms("在法院里") and "スタジアム" in S.terms("はスタジアムへ") and "ศาล" in S.terms("พบศาลและ")
    assert S.terms("12 %") == []


def test_every_term_of_the_sample_is_known(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    many = [word(i) for i in range(6500)]
    df = spark.createDataFrame([(i, "en", " ".join(many)) for i in range(3)], "doc_id bigint, lang string, text string")
    known = S.vocabulary(df)
    assert known == sorted(many)
    encoded = S.encode(df, known)
    assert {r.number: r.n for r in S.document_counts(encoded).collect()} == {-1: 3} | dict.fromkeys(range(6500), 3)
    rare = [6500, 6501]
    found_in = {w: 50 for w in range(6500)} | {w: 3 for w in rare}
    rng = random.Random(1)
    bags = [[[rare[i % 2], *rng.sample(range(6500), 20)] for _ in range(3)] for i in range(40)]
    model = S.fit(bags, [{("law", "sport")[i % 2]} for i in range(40)], found_in, 1000, ["law", "sport"])
    used = {t for document in bags for s in document for t in s}
    assert model.known.tolist() == sorted(used)
    places, there = model.places(np.array([6500, 6501, 7000]))
    assert there.tolist() == [True, True, False]
    assert model.subjects(places, there, np.array([0, 1, 2]), np.array([1, 2, 3])).tolist() == [0, 1, 2]


def test_encoding_keeps_every_sentence(spark):
    rows = [(1, "en", "Red fish. Blue bird here! Zzz."), (2, None, "Red bird."), (3, "en", None), (4, "en", " 12 "), (1, "en", "Red fish. Blue bird here! Zzz.")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("ends", F.lit("clash"))
    known = ["bird", "blue", "fish", "red"]
    got = sorted(((r.doc_id, r.lang, [sorted(r.numbers[a:b]) for a, b in zip([0, *r.ends], r.ends)], r.sizes) for r in S.encode(df, known).collect()), key=str)
    each = [[2, 3], [0, 1], []]
    assert got == [(1, "en", each, [2, 3, 1]), (1, "en", each, [2, 3, 1]), (2, None, [[0, 3]], [2])]


def test_sample_is_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(S, "FIT_DOCUMENTS", 100)
    df = spark.range(4000).selectExpr("id doc_id", "if(id % 100 = 0, 'yo', 'en') lang", "'x' text")
    labels = spark.range(4000).selectExpr("id doc_id", "'law' subject")
    n = {r.lang: r["count"] for r in S.fit_sample(df, labels).join(df.select("doc_id", "lang"), "doc_id").groupBy("lang").count().collect()}
    assert n["yo"] == 40 and 100 <= n["en"] <= 300


def test_no_model_is_cut(spark, monkeypatch):
    rows, labels, _ = corpus(200)
    schema, given = "doc_id bigint, lang string, text string", spark.createDataFrame(labels, "doc_id bigint, subject string, rater string")
    codes = [(10_000 + 10 * i + k, f"a{i}", "The page was last revised.") for i in range(3) for k in range(4)]
    df = spark.createDataFrame([r for r in rows if r[1] != "fr"] + codes, schema)
    monkeypatch.setattr(S, "MOST_LANGUAGES", 2)
    assert S.document_subjects(df, given, ["law", "sport"]).count() > 0
    monkeypatch.setattr(S, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        S.document_subjects(df, given, ["law", "sport"])
