import hashlib
import io
import urllib.error

import pytest
from pyspark.sql import functions as F

from verbascope.operators import audit as A
from verbascope.operators import fertility as Z
from verbascope.operators import sampling as R
from verbascope.sources import collection as C
from verbascope.sources import fetch
from verbascope.sources import files as I


def test_sub_corpus_keeps_judged(spark):
    corpus = spark.range(100).select(F.lit("en").alias("lang"), F.concat(F.lit("d"), "id").alias("docid"))
    judged = spark.createDataFrame([("en", "d3"), ("en", "d7"), ("en", "gone")], "lang string, docid string")
    got = R.sub_corpus(corpus, judged, 20, 1)
    rows = {r.docid: r.judged for r in got.collect()}
    assert len(rows) == 20 and rows["d3"] and rows["d7"] and sum(rows.values()) == 2
    again = {r.docid for r in R.sub_corpus(corpus.repartition(7), judged, 20, 1).collect()}
    assert again == set(rows) and {r.docid for r in R.sub_corpus(corpus, judged, 20, 2).collect()} != again
    whole = R.sub_corpus(corpus, judged, 1, 1)
    assert {r.docid for r in whole.collect()} == {"d3", "d7"}
    m = R.manifest(got, judged, 20).first()
    assert (m.n_actual, m.n_judged_docs_expected, m.n_judged_docs_found, m.n_judged_docs_missing, m.judged_fraction) == (20, 3, 2, 1, 0.1)
    assert m.docid_sha256 == hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()
    assert R.first_missing(R.missing_judged(corpus, judged)).first().missing_judged_sample == ["gone"]
    assert R.sub_corpus(corpus.limit(0), judged, 5, 1).count() == 0


def test_bottom_k_is_uniform(spark):
    df = spark.range(40).select(F.lit("x").alias("g"), F.col("id").cast("string").alias("k"))
    hits = [0] * 40
    for seed in range(60):
        for r in R.bottom_k(df, "g", "k", 10, seed).collect():
            hits[int(r.k)] += 1
    assert sum(hits) == 600 and 3 <= min(hits) and max(hits) <= 29


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 1, "old"), ("a", 2, 2, "new"), ("a", 2, 1, "other"), (None, 9, 9, "x"), ("b", None, 3, None)], "k string, t int, id int, v string")
    assert {r.k: r.v for r in C.latest(df, ["k"], ["t", "id"]).collect()} == {"a": "new", "b": None}


def test_files(spark, tmp_path):
    corpus = spark.createDataFrame([("1#2", None, 'tab\t"q"'), ("1#10", "ti", None), ("2#0", "", "ü")], "docid string, title string, text string")
    I.write_corpus(corpus.repartition(2), f"{tmp_path}/c")
    assert sorted(map(tuple, I.read_corpus(spark, f"{tmp_path}/c").collect())) == [("1#10", "ti", ""), ("1#2", "", 'tab\t"q"'), ("2#0", "", "ü")]
    (tmp_path / "bad.jsonl").write_text('{"docid": "a", "text": "x"}\n{"docid": \nnot json\n{"docid": "b", "title": "t", "text": "y"}\n')
    assert sorted(map(tuple, I.read_corpus(spark, f"{tmp_path}/bad.jsonl").collect())) == [("a", "", "x"), ("b", "t", "y")]
    (tmp_path / "topics.tsv").write_text("q1\twhat is # this\textra\nq2\nq3\t \n")
    assert sorted(map(tuple, I.read_topics(spark, f"{tmp_path}/topics.tsv").collect())) == [("q1", "what is # this"), ("q3", "")]
    (tmp_path / "qrels.tsv").write_text("q1\t0\t10020#0\t1\nq1\t0\tx\tnone\nq2\t0\ty\t-1\nq1\t0\tz\n")
    assert sorted(map(tuple, I.read_judgments(spark, f"{tmp_path}/qrels.tsv").collect())) == [("q1", "10020#0", 1), ("q2", "y", -1)]
    known = spark.createDataFrame([("q1",)], "qid string")
    assert I.read_judgments(spark, f"{tmp_path}/qrels.tsv", known).count() == 1
    (tmp_path / "m.json").write_text('{"languages": {"yo": {"mb": 1.5, "n": {"a": 1}}, "sw": {"mb": 2}}}')
    assert {r.lang: r.mb for r in I.read_language_map(spark, f"{tmp_path}/m.json", "mb double").collect()} == {"yo": 1.5, "sw": 2.0}
    (tmp_path / "shards").mkdir()
    (tmp_path / "shards/a.jsonl.gz").write_bytes(b"12345")
    (tmp_path / "shards/b.txt").write_bytes(b"1")
    assert tuple(I.shard_volume(I.shards(spark, f"{tmp_path}/shards")).first()) == (1, 5)
    assert tuple(I.shard_volume(I.shards(spark, f"{tmp_path}/shards", ".none")).first()) == (-1, -1)


def test_atom(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/2301.00001v2</id><title>A\n  title</title><published>2023</published><author><name>N One</name></author><author><name>N Two</name></author></entry></feed>'
    got = I.atom_entries(spark.createDataFrame([(feed,)], "x string"), "x").first()
    assert (got.id, got.title, got.authors) == ("2301.00001", "A title", ["N One", "N Two"])


def test_upsert(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"), spark.createDataFrame([("b", 9), ("c", 8)], "k string, v int")
    assert sorted(map(tuple, I.upsert(old, new, ["k"]).collect()), key=str) == sorted([("a", 1), ("b", 9), ("c", 8), (None, 3)], key=str)
    assert I.upsert(old.limit(0), new, ["k"]).count() == 2


class Answer(io.BytesIO):
    def __init__(self, body, length):
        super().__init__(body)
        self.headers = {"Content-Length": length}


def test_fetch_retries():
    pauses, answers = [], [urllib.error.URLError("down"), Answer(b"abc", "9"), Answer(b"abc", "3")]

    def opener(url, timeout):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert fetch.fetch("u", opener=opener, sleep=pauses.append) == b"abc" and pauses == [3, 6]
    with pytest.raises(OSError):
        fetch.fetch("u", retries=1, opener=lambda *a, **k: Answer(b"", "1"), sleep=pauses.append)


def test_fetch_json_and_rows(tmp_path):
    quiet = {"retries": 1, "sleep": lambda s: None}
    give = lambda body: (lambda url, timeout: Answer(body, str(len(body))))
    assert fetch.fetch_json("u", opener=give(b'[{"type": "file", "size": 3}]'), **quiet) == [{"type": "file", "size": 3}]
    assert fetch.fetch_rows("u", 2, opener=give(b"q1\ttext\r\nq2\n\xff\tx\n"), **quiet) == [["q1", "text"], ["\ufffd", "x"]]

    def down(url, timeout):
        raise urllib.error.URLError("down")

    assert fetch.fetch_rows("u", opener=down, **quiet) is None


def test_reference_check(spark):
    entries = spark.createDataFrame([("a", "B title", "2023-01-01", ["x", "y"]), ("a", "A title", "2022-01-01", ["x"]), ("z", "unused", "2020", [])], "id string, title string, published string, authors array<string>")
    cited = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    got = {tuple(r) for r in A.reference_check(cited, entries).collect()}
    assert got == {("a", "VERIFIED", "A title", "2022", 1), ("b", "NOT_FOUND", None, None, None)}
    assert A.reference_check(cited.limit(0), entries).count() == 0 and A.reference_check(cited, entries.limit(0)).count() == 2


def test_http_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    spark.dataSource.register(fetch.HttpLines)
    got = spark.read.format("http_lines").option("urls", f"file://{tmp_path}/a.txt").load()
    assert [tuple(r)[1:] for r in got.orderBy("line_no").collect()] == [(0, "one"), (1, "two")]


def test_audits(spark):
    text = "mean 0.2627 and 0.26 \\cite{2024key} % 99\nkept 50\\% of 7.125 and 12345\\ref{fig1}"
    df = spark.createDataFrame([("m", text)], "key string, text string")
    tokens = A.numbers(df, "key", "text")
    assert {r.token for r in tokens.collect()} == {"0.2627", "0.26", "50", "7.125", "12345"}
    values = spark.createDataFrame([(0.26274,), (50.0,), (7.1,)], "v double")
    left = {r.token for r in A.untraced(tokens, A.rendered_values(values, "v"), spark.createDataFrame([], "token string")).collect()}
    assert left == {"7.125", "12345"}
    cited = A.cited_keys(spark.createDataFrame([("m", r"\cite{a, b}\cite{b,c} 5\% \cite{d} % \cite{no}")], "key string, text string"), "key", "text")
    assert {r.cited for r in cited.collect()} == {"a", "b", "c", "d"}
    entries = A.bibliography(spark.createDataFrame([("@Article{a,\n x}\n@misc{ e ,\n}",)], "text string"), "text")
    assert {tuple(r) for r in entries.collect()} == {("a", "article"), ("e", "misc")}
    assert {tuple(r) for r in A.citation_report(cited, entries).collect()} == {("b", "missing"), ("c", "missing"), ("d", "missing"), ("e", "unused")}
    checks = A.wording(spark.createDataFrame([("m", "one\nbecause of tokeniz two")], "key string, text string"), "key", "text", {"has one": "^one$"}, {"no cause": "because of tokeniz"})
    assert {r.label: r.passed for r in checks.collect()} == {"has one": True, "no cause": False}
    leaves = A.json_leaves(spark.createDataFrame([(1, '{"a": [1, {"b": "x"}], "c": true, "d": null}'), (2, "bad"), (3, None)], "id int, j string"), "id", "j")
    assert {(r.path, r.number, r.string) for r in leaves.collect()} == {("$.a[0]", 1.0, None), ("$.a[1].b", None, "x"), ("$.c", 1.0, None)}


def test_fertility(spark):
    df = spark.createDataFrame([("en", "One words, longer"), ("en", None), ("fr", " ")], "lang string, text string")
    got = {r.family: r for r in Z.measure(df, ["lang"], "text").collect()}
    assert (got["char4"].n_words, got["char4"].n_chars, got["char4"].n_tokens) == (3, 15, 1 + 3 + 3) and got["whole"].fertility == 1.0


@pytest.mark.parametrize("name", Z.VOCABULARIES)
def test_fertility_equals_the_libraries(spark, name):
    import unicodedata

    from verbascope.functions.subwords import counter

    texts = [("en", "One words, longer ﬁnal"), ("en", "One"), ("en", None), ("fr", " "), ("th", "ภาษาไทย ｗｉｄｅ"), (None, "x")]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "lang string, text string, word string").repartition(3)
    got = {r.lang: tuple(r)[2:] for r in Z.measure_subwords(df, ["lang"], "text", (name,)).collect()}
    count = counter(name)
    for lang in ("en", "th", None):
        own = [w for x, t in texts if x == lang and t for w in unicodedata.normalize("NFKC", t).split()]
        tokens = [count(w) for w in own]
        chars = sum(map(len, own))
        ratios = (sum(tokens) / len(own), tokens.count(1) / len(own), sum(tokens) / chars)
        assert got[lang][:3] == (len(own), chars, sum(tokens)) and got[lang][3:] == pytest.approx(ratios, abs=6e-5)
    assert "fr" not in got and Z.measure_subwords(df.limit(0), ["lang"], "text", (name,)).count() == 0


def test_every_text_is_a_file(spark):
    from conftest import SMALL

    from verbascope.queries import queries

    texts = spark.read.parquet(f"{SMALL}/documents.parquet").where("text <> ''").selectExpr("doc_id", "cast(length(text) as bigint)")
    expected = sorted(map(tuple, texts.collect()))
    assert len(expected) > 8 and sorted((r.doc_id, r.n_chars) for r in queries()["s14_whole_texts"](spark, SMALL).collect()) == expected


def test_places_of_a_group_over_many_ranges(spark):
    from verbascope.operators.ranking import shard_of, with_place

    rows = [("hot", i % 700, f"k{i:04}") for i in range(2100)] + [("cold", 1, "a"), (None, 2, "b"), (None, 1, "c"), ("cold", None, "d")]
    df = spark.createDataFrame(rows, "g string, x int, k string")
    got = with_place(df.repartition(7), ["g"], ["x", "k"]).withColumn("shard", shard_of(F.col("place"), 4)).collect()
    assert len(got) == len(rows)
    first = lambda x: (x is not None, x or 0)
    for g in ("hot", "cold", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (first(r[1]), r[2]))
        assert [(r.x, r.k) for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == [r[1:] for r in own]
        assert sorted(r.place for r in got if r.g == g) == list(range(1, len(own) + 1))
    assert all(r.shard == (r.place - 1) // 4 for r in got)
    assert with_place(df.limit(0), ["g"], ["x"]).count() == 0


def test_bottom_k_beyond_the_group_limit(spark, monkeypatch):
    df = spark.range(3000).selectExpr("if(id < 20, 'few', 'many') g", "cast(id as string) k")
    window = {tuple(r) for r in R.bottom_k(df, "g", "k", 150, 5).collect()}
    monkeypatch.setattr(R, "GROUP_LIMIT", 10)
    assert {tuple(r) for r in R.bottom_k(df, "g", "k", 150, 5).collect()} == window and len(window) == 170
