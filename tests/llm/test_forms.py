import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphweir.llm import forms

ALIKE = [("ＡＢ１", "AB1"), ("naïf", "naïf"), ("ǖ", "ǖ"), ("ａ́", "á"), ("词​库", "词库"), ("a\xad⁠﻿b", "ab"), ("a b", "a　b"), ("a\xa0b", "a b"), ("АDС", "ADC"), ("ΚB", "KB"), ("KB", "KB"), ("kΩ", "kΩ"), ("µF", "μF"), ("⼒度", "力度"), ("ﬁle", "file"), ("ё", "ë"), ("о́", "ó"), ("Å", "Å"), ("Ⅳ", "IV"), ("", "")]
UNLIKE = [("a", "A"), ("x²", "x2"), ("②", "2"), ("未", "末"), ("Π", "п"), ("a b", "ab"), ("é", "e"), ("木", "本")]


@pytest.fixture(scope="module")
def form(spark):
    texts = sorted({t for p in ALIKE + UNLIKE for t in p})
    df = forms.one_form(spark.createDataFrame([(t, 1) for t in texts] + [(None, 1)], "text string, form int"), {"text": "form"})
    return {r.text: r.form for r in df.collect()}


def test_alike_and_unlike(form):
    for a, b in ALIKE:
        assert form[a] == form[b], (a, b, form[a], form[b])
    for a, b in UNLIKE:
        assert form[a] != form[b], (a, b)
    assert form[None] is None and form[""] == ""


def test_forms_are_stable(spark, form):
    own = [f for f in form.values() if f]
    again = forms.one_form(spark.createDataFrame([(f,) for f in own], "text string"), {"text": "form"}).collect()
    assert all(r.text == r.form for r in again)
    assert all(unicodedata.normalize("NFC", f) == f for f in own)


def test_extra_columns_and_long_texts(spark):
    df = spark.createDataFrame([(1, "Ａ" * 300_000, "x", [1], None), (1, None, "y", None, 2)], "id int, text string, f0 string, batch array<int>, __0 int")
    rows = forms.one_form(df, {"text": "form"}).orderBy("f0").collect()
    assert rows[0].form == "A" * 300_000 and rows[0].batch == [1] and rows[1].form is None and rows[1]["__0"] == 2
    assert forms.one_form(df.limit(0), {"text": "form"}).count() == 0


def brute(rows, form):
    return sorted({(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] != b[1] and a[2] and b[2] and a[2] != b[2] and form[a[2]] == form[b[2]]})


def test_pairs_within_a_table(spark, form):
    texts = ["АDС", "ADC", "ＡＤＣ", "ADC", "adc", None, "", "kΩ"]
    form = form | {"adc": "adc", "ADC": "ADC", "ＡＤＣ": "ADC"}
    rows = [(p, 10 * (p or 9) + i, t) for p in (1, 2, None) for i, t in enumerate(texts)] * 2
    got = forms.alike_pairs(spark.createDataFrame(rows, "pkg int, id int, text string"), None, ["pkg"])
    assert sorted(map(tuple, got.collect())) == brute([r for r in rows if r[0] is not None], form)


def test_pairs_across_and_hot_groups(spark):
    left = spark.createDataFrame([(1, i, "КB") for i in range(400)] + [(1, 1000, "KB"), (2, 5, "a")], "k int, id int, text string")
    right = spark.createDataFrame([(1, 2000, "KB"), (1, 3, "КB"), (1, 7, "ＫB"), (2, 5, "ａ"), (2, 6, None)], "k int, id int, text string")
    got = {tuple(r) for r in forms.alike_pairs(left, right, ["k"]).collect()}
    want = {(i, 2000) for i in range(400)} | {(min(i, 7), max(i, 7)) for i in range(400) if i != 7} | {(3, 1000), (7, 1000)}
    assert got == want
    assert forms.alike_pairs(left.limit(0), right, ["k"]).count() == 0


def test_statement_is_embedded_sql():
    assert "nfc_normalize" in forms.form_sql("x") and "translate" in forms.form_sql("x") and "regexp_replace" in forms.form_sql("x")
    assert all(len(k) == len(v) == 1 for k, v in forms.single_map().items())
    assert F is not None
