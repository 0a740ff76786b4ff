import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm.glyphs import canonical, canonical_text, equal_looking, normalize_glyphs


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_stable_and_canonical(t):
    once = canonical(t)
    assert canonical(once) == once and unicodedata.is_normalized("NFC", once)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé ñ漢字ABCü.,-\n", max_size=40), st.randoms(use_true_random=False))
def test_disguises_come_back(t, r):
    t = unicodedata.normalize("NFC", t)
    twin = {"a": "а", "c": "с", "e": "е", "B": "В", "A": "Α", "C": "С"}

    def disguise(c):
        k = r.randint(0, 4)
        if k == 0 and c in twin:
            return twin[c]
        if k == 1 and "!" <= c <= "~":
            return chr(ord(c) + 0xFEE0)
        if k == 2 and c == " ":
            return r.choice("    　")
        if k == 3 and c != "\n":
            return unicodedata.normalize("NFD", c) + r.choice(["​", "⁠", "﻿"])
        return c

    assert canonical("".join(map(disguise, t))) == canonical(t)


def test_visible_differences_stay():
    for a, b in (("x²", "x2"), ("①", "1"), ("naïve", "naive"), ("A", "a"), ("α-band", "a-band"), ("10", "1O")):
        assert canonical(a) != canonical(b)
    assert canonical("привет, мир") == "привет, мир" and canonical("℃ ﬁ ⽤") == "°C fi 用"


def test_rows(spark):
    rows = [(1, "Ａ１，"), (2, None), (3, ""), (4, "x" * 300_000 + "é"), (5, "a\r\nb")]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "id int, text string, canonical string")
    got = {r["id"]: (r["canonical"], r["fullwidth_found"]) for r in normalize_glyphs(df).collect()}
    assert got[1] == ("A1,", 3) and got[2] == (None, None) and got[3] == ("", 0) and got[4][0] == "x" * 300_000 + "é" and got[5][0] == "a\nb"
    assert normalize_glyphs(df.limit(0)).count() == 0


def test_pairs(spark):
    pages = spark.createDataFrame([(1, "same text"), (2, "other"), (3, " "), (4, None), (5, "é one")], "id long, text string").withColumn("page", F.col("id"))
    ocr = spark.createDataFrame([(10, 1, "same text"), (11, 1, "ѕame text"), (11, 1, "ѕame text"), (12, 1, "same  Text"), (13, 2, "other"), (14, 3, "　"), (15, 4, None), (16, 5, "é​ one"), (17, 99, "same text")], "id long, page long, text string")
    got = {tuple(r) for r in equal_looking(pages, ocr, "page", "page", "id", "id").collect()}
    assert got == {(1, 11), (5, 16)}
    assert canonical_text is not None


def test_composition_over_cuts():
    for word in ("한국어 글자 각", "বাংলা কোনো লৌহ", "தமிழ் கொடு நௌ", "ẹ́ṩ ǘ", "ကဦ", "൦ ൊ ൌ"):
        nfc, nfd = unicodedata.normalize("NFC", word), unicodedata.normalize("NFD", word)
        assert canonical(nfc) == canonical(nfd) == nfc
        assert canonical("​".join(nfd)) == nfc


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="가각각োৌো়ொொோaeẹ́́​ﬁ　²\n", max_size=30))
def test_forms_agree(t):
    once = canonical(t)
    assert canonical(unicodedata.normalize("NFD", t)) == canonical(unicodedata.normalize("NFC", t)) == once == canonical(once)


def test_forms_are_computed_once(spark):
    df = spark.createDataFrame([(1, 1, "a")], "id long, k long, text string")
    plan = equal_looking(df, df, "k", "k", "id", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") <= 2 and "ArrowEvalPython" not in plan
