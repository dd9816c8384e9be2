import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbascope.llm import bpe, budget

ODD = ["", " ", "  \n\n ", "don't we'll", "a" * 3000, "ab" * 2000, "१२३ 𠮷 👩\u200d🔬", "ไทยไม\u0e48ม\u0e35ช\u0e48องว\u0e48าง" * 300, "x\u200b\ufeff\u00a0y", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(f"{bpe.TOKENIZER_FOLDER}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_published_one():
    public = pytest.importorskip("public_tokenizers")
    assert bpe.PIECES == public.PATTERN


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(library, text):
    own = bpe.encoder("byte_bpe_50k", bpe.TOKENIZER_FOLDER)
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    import tokenizers

    own = bpe.encoder("byte_bpe_50k", bpe.TOKENIZER_FOLDER)
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert own.decode(ids) == text
    other = test_any_text.__dict__.setdefault("other", tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_FOLDER}/byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert ids == other.encode(text, add_special_tokens=False).ids


def test_merge_of_bytes_without_shortcut():
    own = bpe.encoder("byte_bpe_50k", bpe.TOKENIZER_FOLDER)
    for word in ("hello", "straße", "ท\u0e35\u0e48ราบส\u0e39ง"):
        assert b"".join(own.tokens[i] for i in own.merge(word.encode())).decode() == word


def test_encode_texts_keeps_every_row(spark):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.ids) for r in bpe.encode_texts(df, "doc_id", "text").collect())
    assert got == [(0, [87]), (1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    empty = bpe.encode_texts(df.limit(0), "doc_id", "text")
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k", "piece_bpe_32k", "word_bpe_49k"])
def test_counts_of_all_tokenizers(spark, name):
    df = spark.createDataFrame([(1, "One text here"), (2, "One text here"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.n_tokens for r in budget.token_counts(df, ["id"], "text", name).collect()}
    assert got[1] == got[2] == budget.counter(name, bpe.TOKENIZER_FOLDER)("One text here") > 0 and got[3] == got[4] == 0


def test_totals_against_brute_force(spark, library):
    rows = [("a", "en", "same text")] * 5 + [("b", "en", "same text"), ("b", None, "other"), (None, "fr", None), ("a", "en", ""), ("a", "en", "third one")]
    df = spark.createDataFrame(rows, "source string, lang string, text string").withColumn("n_tokens", F.lit(7)).withColumn("h1", F.lit(1))
    got = {(r.source, r.lang): (r.n_texts, r.n_distinct, r.n_tokens, r.n_distinct_tokens) for r in budget.token_totals(df, ["source", "lang"], "text").collect()}
    expected = {}
    for key in {r[:2] for r in rows}:
        texts = [t for *k, t in rows if tuple(k) == key]
        n = lambda ts: sum(len(library.encode_ordinary(t)) for t in ts)
        there = [t for t in texts if t]
        expected[key] = (len(texts), len(set(there)), n(there), n(set(there)))
    assert got == expected
    assert budget.token_totals(df.limit(0), ["lang"], "text").count() == 0


def test_plain_names(spark):
    df = spark.createDataFrame([("EN", " Forum "), ("ru-x", "FORUM"), (None, " "), ("", None)], "lang string, name string")
    got = [tuple(r) for r in df.select(budget.plain_language(F.col("lang")), budget.plain_name(F.col("name"))).collect()]
    assert got == [("en", "forum"), ("ru", "forum"), (None, None), (None, None)]
