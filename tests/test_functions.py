"""Scalar functions and the fuzzy score."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridra.functions import contact, country, fuzzy, text
from veridra.operators import normalize


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_title_raises_after_every_non_letter(spark):
    values = ["react.js o'brien node-js", "c++ 3d", "", None]
    assert column(spark, values, text.title) == [v.title() if v is not None else None for v in values]


def test_strip_takes_all_white_space(spark):
    assert column(spark, ["\t a \n", " ", None], text.strip) == ["a", "", None]


def test_quoted_shows_as_python_does(spark):
    values = ["x", "it's", 'a "b"', "it's \"b\"", "a\\b", None]
    assert column(spark, values, text.quoted) == [repr(v) for v in values]


def test_normalize_email_and_name(spark):
    assert column(spark, ["  ANA@Example.ORG "], normalize.normalize_email) == ["ana@example.org"]
    assert column(spark, [" ana  o'lea & co. "], normalize.normalize_name) == ["Ana Olea Co."]


@pytest.mark.parametrize(
    ("shown", "wanted"),
    [
        ("(415) 555-2671", "+14155552671"),
        ("98765-11111", "+19876511111"),
        ("(+91) 9988776655", "+919988776655"),
        ("+44 20 7946 0958", "+442079460958"),
        ("1-415-555-2671", "+14155552671"),
        ("+999 123456789012345", None),
        ("call me", None),
        ("12", None),
        ("", None),
    ],
)
def test_phones(spark, shown, wanted):
    assert column(spark, [shown], contact.to_e164) == [wanted]


def test_dates(spark):
    values = ["Sep 2023", "september 2023", "2020-05", "2020-05-17", "05/2021", "2019", "Present", "", None, "soon"]
    wanted = ["2023-09", "2023-09", "2020-05", "2020-05", "2021-05", "2019-01", None, None, None, "soon"]
    assert column(spark, values, contact.to_month) == wanted


def test_dates_among_words(spark):
    values = ["since March 2019", "17 Sept. 2020", "2018, Dec.", "summer 2017", "17/05/2020", "05.2021", "marketing 2016", "room 12345", "in May"]
    wanted = ["2019-03", "2020-09", "2018-12", "2017-01", "2020-05", "2021-05", "2016-01", "room 12345", "in May"]
    assert column(spark, values, contact.to_month) == wanted


def test_all_countries(spark):
    shown = ["Türkiye", "turkey", "Côte d’Ivoire", "BRA", "nzl", "South Korea", "U.K.", "Trinidad and Tobago", "bosnia & herzegovina"]
    assert column(spark, shown, country.to_alpha2) == ["TR", "TR", "CI", "BR", "NZ", "KR", "GB", "TT", "BA"]
    assert len(set(country.codes().values())) > 240


def test_email_and_phone_forms(spark):
    assert column(spark, ["a.b@c.org", "a@b", "@c.org", None], contact.is_email) == [True, False, False, False]
    assert column(spark, ["+14155552671", "14155552671", "+0123", None], contact.is_e164) == [True, False, False, False]


def test_found_phones(spark):
    shown = "a +91 9876543210 b (415) 555-2671 c 98765-11111"
    assert column(spark, [shown], contact.extract_phones) == [["+91 9876543210", "(415) 555-2671"]]


def test_countries(spark):
    assert column(spark, [" india ", "IN", "Atlantis", None], country.to_alpha2) == ["IN", "IN", "Atlantis", None]
    assert column(spark, ["GB", "FR", None], country.full_name) == ["United Kingdom", "FR", None]


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [
        ("c", "PyTorch", 90, 90),
        ("react", "React", 80, 80),
        ("javascript", "JavaScript", 80, 80),
        ("machine learnin", "Machine Learning", 83.8, 83.9),
        ("pytorch", "PyTorch", 71.4, 71.5),
        ("java", "javascript", 90, 90),
        ("sql", "Python", 0, 79.9),
        ("", "x", 0, 0),
        ("same", "same", 100, 100),
    ],
)
def test_weighted_ratio(a, b, low, high):
    assert low <= fuzzy.weighted_ratio(a, b) <= high


def slow_common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_properties(a, b):
    assert fuzzy.common_subsequence(a, b) == slow_common(a, b)
    assert 0 <= fuzzy.weighted_ratio(a, b) <= 100
    assert fuzzy.weighted_ratio(a, b) == pytest.approx(fuzzy.weighted_ratio(b, a))


def test_skill_table(spark):
    words = spark.createDataFrame([("ml",), ("machine learnin",), ("cobol",), ("node",), ("c",)], "skill_key string")
    found = {r[0]: (r[1], r[2]) for r in normalize.skill_table(words).collect()}
    assert found["ml"] == ("Machine Learning", "Canonical_Alias_Map")
    assert found["node"] == ("Node.js", "Canonical_Alias_Map")
    assert found["machine learnin"] == ("Machine Learning", "Fuzzy_Match_84pct")
    assert found["c"] == ("PyTorch", "Fuzzy_Match_90pct")
    assert found["cobol"] == ("Cobol", "TitleCase_Fallback")
