import itertools

import pytest

from verbascope.llm import lookalike
from verbascope.llm.lookalike import consistent_token, look_alike_pairs, normal_form, normal_forms

SAME = [
    ("en", "Straße file", "Straße ﬁle"),
    ("en", "wide ABC 123!", "ｗｉｄｅ\u3000ＡＢＣ １２３！"),
    ("en", "no break", "no\u00a0break"),
    ("en", "hidden", "hid\u200bd\u00aden\ufeff"),
    ("en", "hidden", "hid\u200cd\u200den\u2060"),
    ("es", "Después", "Despue\u0301s"),
    ("en", "repository", "rероѕіtоrу"),
    ("en", "cope", "соре"),
    ("ru", "важнее", "вaжнee"),
    ("ru", "сор", "cop"),
    ("ru", "Ещё", "Eщё"),
    ("de", "Talente", "Τalеnte"),
    ("yo", "L\u1ecdz\u1eb9", "L\u043e\u0323z\u0435\u0323"),
    ("ja", "ガギグ", "ｶﾞｷﾞｸﾞ"),
    ("ja", "ガ", "カ\u3099"),
    ("zh", "人力", "⼈⼒"),
    ("ko", "\ud55c\uae00", "\u1112\u1161\u11ab\u1100\u1173\u11af"),
    ("ar", "لا", "ﻻ"),
    ("ar", "آ", "ا\u0653"),
    ("hi", "\u0958", "\u0915\u093c"),
    ("th", "น\u0e49ำ", "น\u0e49\u0e4dา"),
    ("th", "น\u0e49ำ", "น\u0e4d\u0e49า"),
    ("th", "แม\u0e48", "เเม\u0e48"),
    ("te", "క\u0c48", "క\u0c46\u0c56"),
    ("en", "  a \n b ", "a b"),
    ("fa", "دا", "د\u200cا"),
    ("fa", "\u06ccک", "\u064aک"),  # initial yeh
    ("fa", "ب\u06ccن", "ب\u064aن"),  # medial
    ("ar", "ب\u064aن", "ب\u06ccن"),
    ("fa", "ب\u064a\u064eن", "ب\u06cc\u064eن"),  # a mark between does not part them
    ("fa", "عل\u06cc", "عل\u0649"),  # final, without dots
    ("fa", "\u06a9تاب", "\u0643تاب"),  # initial kaf
    ("fa", "م\u06a9ان", "م\u0643ان"),  # medial
]
DIFFERENT = [
    ("fa", "عل\u06cc", "عل\u064a"),  # final, with and without dots
    ("fa", "را\u06cc د", "را\u064a د"),  # before a blank
    ("fa", "\u06cc", "\u064a"),  # alone
    ("ar", "ملک", "ملك"),  # final kaf
    ("ar", "ب\u0649ن", "ب\u064aن"),  # medial, with and without dots
    ("en", "Bank", "bank"),
    ("en", "resume", "résumé"),
    ("en", "m2", "m²"),
    ("en", "a,b", "a.b"),
    ("ar", "123", "١٢٣"),
    ("fa", "می\u200cشود", "میشود"),
    ("te", "క\u0c4d\u200cవ", "క\u0c4dవ"),
    ("en", "👩\u200d🔬", "👩🔬"),
    ("en", "ſ", "s"),
    ("en", "¼", "1⁄4"),
    ("ko", "ㅎㅏ", "하"),
    ("en", "a b", "ab"),
]


@pytest.mark.parametrize(("lang", "a", "b"), SAME)
def test_same(lang, a, b):
    assert a != b and normal_form(a, lang) == normal_form(b, lang)


@pytest.mark.parametrize(("lang", "a", "b"), DIFFERENT)
def test_different(lang, a, b):
    assert normal_form(a, lang) != normal_form(b, lang)


def test_forms_are_stable():
    for lang, a, b in SAME + DIFFERENT:
        for text in (a, b):
            once = normal_form(text, lang)
            assert normal_form(once, lang) == once
    assert normal_form(None, "en") is None and normal_form(" \u3000\u200b", "en") == "" and normal_form("x", None) == "x"
    assert len(normal_form("оn " * 100_000, "en")) == 299_999


def test_tokens_that_no_script_spells():
    assert consistent_token("яfа", "Latin") == consistent_token("яfa", "Latin")
    assert consistent_token("рaссказ", "Latin") == "рассказ"


@pytest.mark.parametrize("block", [2000, 7])
def test_pairs_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(lookalike, "BLOCK_ROWS", block)
    rows = []
    for i, (lang, a, b) in enumerate(SAME + DIFFERENT):
        rows += [(0, 10 * i, str(i), lang, a), (0, 10 * i + 1, str(i), lang, b), (0, 10 * i + 2, str(i), lang, b)]
    rows += [(1, 5000 + i, "p", "en", "hot title" if i % 97 else "hot\u2007title") for i in range(400)]
    rows += [(1, 6000, "q", "en", "hot\u00a0title"), (1, None, "p", "en", "hot\u00a0title"), (1, 6001, None, "en", "hot\u00a0title"), (1, 6002, "p", None, "hot\u00a0title"), (1, 6003, "p", "en", None), (1, 6004, "p", "en", ""), (1, 6005, "p", "en", " \t")]
    df = spark.createDataFrame(rows, "kind int, id bigint, scope string, lang string, value string")
    got = sorted(tuple(r) for r in look_alike_pairs(df.repartition(5)).collect())
    expected = sorted(
        (x[0], min(x[1], y[1]), max(x[1], y[1]))
        for x, y in itertools.combinations(rows, 2)
        if None not in x and None not in y and (x[0], x[2], x[3]) == (y[0], y[2], y[3]) and x[4] != y[4] and normal_form(x[4], x[3]) == normal_form(y[4], y[3]) != ""
    )
    assert got == expected and len(got) > 1900
    assert look_alike_pairs(df.limit(0)).count() == 0
    classes = {(r.kind, r.id): r for r in lookalike.look_alike_classes(df.repartition(3)).collect()}
    text = {(r[0], r[1]): r[4] for r in rows if r[1] is not None}
    assert classes.keys() == {x for k, a, b in got for x in ((k, a), (k, b))}
    for (k, a), own in classes.items():
        alike = [b for (x, b), other in classes.items() if x == k and other.form_id == own.form_id]
        assert own.form_id == min(alike) and own.spelling_id == min(b for b in alike if text[k, b] == text[k, a])
    expected_links = {(k, a, b) for (k, a), x in classes.items() for (m, b), y in classes.items() if k == m and a < b and x.form_id == y.form_id and x.spelling_id != y.spelling_id}
    assert expected_links == set(got)


def test_normal_forms_keep_rows(spark):
    df = spark.createDataFrame([(1, "en", "ａ"), (1, "en", "ａ"), (2, None, None), (3, "ru", "")], "id int, lang string, text string").selectExpr("*", "'clash' normal")
    got = sorted(tuple(r) for r in normal_forms(df, ["id"], "lang", "text").collect())
    assert got == [(1, "a"), (1, "a"), (2, None), (3, "")]
