import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footmesh.llm import lookalike as L

SAME = [("ﬁle", "file"), ("ｆｕｌｌ（１）", "full(1)"), ("é", "é"), ("a​b⁠c﻿", "abc"), ("a b c d　e", "a b c d e"), ("раsѕ", "pass"), ("Τhе", "The"), ("рaйoнa", "района"), ("ё", "ë"), ("q̣̇", "q̣̇"), ("ẹ́", "ẹ́"), ("한", "한")]
OTHER = [("a", "A"), ("e", "é"), ("a b", "a  b"), ("a\nb", "a b"), ("a.", "a,"), ("1", "2"), ("²", "2"), ("①", "1"), ("a\tb", "a b"), ("l", "1"), ("…", "..."), ("и", "й")]


def test_known_pairs():
    for a, b in SAME:
        assert L.normal_texts([a]) == L.normal_texts([b]), (a, b)
    for a, b in OTHER:
        assert L.normal_texts([a]) != L.normal_texts([b]), (a, b)


def test_what_shows_is_kept():
    family, persian, flag = "👨\u200d👩\u200d👧", "می\u200cخواهم", "🏴\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f"
    for shown, hidden in ((family, "👨👩👧"), (persian, "میخواهم"), (flag, "🏴"), ("☺\ufe0f", "☺"), ("葛\U000e0100", "葛"), ("1\ufe0f\u20e3", "1\u20e3"), ("क्\u200dष", "क्ष")):
        assert L.normal_texts([shown]) != L.normal_texts([hidden]), shown
        assert L.normal_texts(["x", shown, "y"])[1] == shown
    for a, b in (("a\u200db", "ab"), ("a\u200c", "a"), ("x\ufe0f", "x"), ("1\ufe0f", "1"), ("\u200d", ""), ("a\U000e0067", "a")):
        assert L.normal_texts([a]) == [b]
    # what stands in another text is no neighbour
    assert L.normal_texts(["👨", "\u200d", "👩"]) == ["👨", "", "👩"]


def test_fonts_and_numerals():
    for a, b in (("𝐇𝐞𝐥𝐥𝐨", "Hello"), ("a\u2011b", "a\u2010b"), ("Ⅳ", "IV"), ("𝟘", "0"), ("ﬁ", "fi")):
        assert L.normal_texts([a]) == L.normal_texts([b]), a


def test_confusables_from_the_engine(spark):
    got = L.confusables(spark)
    assert len(got) > 150 and got[ord("а")] == "a" and got[ord("Ι")] == "I" and got[ord("Ꭵ")] == "i"
    assert all(len(v) == 1 and v.isascii() for v in got.values())
    # no two letters of an alphabet become one, but for its own look-alikes
    maps = L.build_maps(got)
    assert L.normal_texts(["Ꮪаmе", "Same"], maps) == ["Same", "Same"]
    assert len(set(L.normal_texts(list("абвгдежзийклмнопрстуфхцчшщъыьэюя"), maps))) == 32


def test_order_and_bounds():
    texts = ["", "plain", "e", "́", "​", "x" * 10 + "é", "ﬁ" * 1000, "", "z"]
    assert L.normal_texts(texts) == ["", "plain", "e", "́", "", "x" * 10 + "é", "fi" * 1000, "", "z"]


def test_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(L, "SLICE", 1000)
    text = ("ａb́" * 5000) + "end"
    assert L.normal_texts([text, "ｚ", text]) == [unicodedata.normalize("NFC", "ab́" * 5000) + "end", "z", unicodedata.normalize("NFC", "ab́" * 5000) + "end"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_idempotent_and_canonical(texts):
    once = L.normal_texts(texts)
    assert L.normal_texts(once) == once
    assert L.normal_texts([unicodedata.normalize("NFD", t) for t in texts]) == once
    assert all(unicodedata.is_normalized("NFC", t) for t in once)


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, form string")
    return sorted(tuple(r) for r in L.lookalike_pairs(df, "doc_id", "text").collect())


def test_pairs(spark):
    rows = [(1, "file"), (2, "ﬁle"), (3, "file"), (4, "ｆile"), (5, None), (None, "ﬁle"), (6, ""), (7, ""), (8, "​"), (1, "file"), (9, "File")]
    assert pairs(spark, rows) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (6, 8), (7, 8)]
    assert pairs(spark, []) == []


def test_one_hot_text_makes_no_pairs(spark):
    assert pairs(spark, [(k, "same") for k in range(500)] + [(1000, "ѕame")]) == [(k, 1000) for k in range(500)]


def test_classes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id bigint, text string")
    got = {r.id: (r.n_variants, r.n_docs, r.class_id) for r in L.lookalike_classes(df, "doc_id", "text").collect()}
    assert got[1] == got[2] and got[1][:2] == (2, 2) and got[3][:2] == (1, 1)


@pytest.mark.parametrize("value", [None, "ﬁ"])
def test_column(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(L.normal_form(df.t)).first()[0] == (None if value is None else "fi")
