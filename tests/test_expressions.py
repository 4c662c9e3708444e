"""Scalar rules, value by value."""

import math

import pytest

from tallyloom.functions import classify, numeric, text

INF, NAN = math.inf, math.nan


def values(spark, kind, rows, *expressions):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}").orderBy("i")
    return [tuple(r) if len(expressions) > 1 else r[0] for r in frame.selectExpr(*expressions).collect()]


@pytest.mark.parametrize(
    "build, cases",
    [
        (classify.sentiment, {
            1.0: "Negative", 2.0: "Negative", 2.9: "Negative", 3.0: "Neutral", 3.5: "Neutral", 4.0: "Positive",
            4.5: "Positive", 5.0: "Positive", 0.0: "Unknown", 0.5: "Unknown", 6.0: "Unknown", -1.0: "Unknown",
            None: "Unknown", INF: "Unknown", -INF: "Unknown", NAN: "Unknown",
        }),
        (classify.recommendation_label, {
            1.0: "Recommended", 1.9: "Recommended", 0.0: "Not Recommended", 0.5: "Not Recommended",
            -0.5: "Not Recommended", 2.0: "Unknown", -1.0: "Unknown", None: "Unknown", INF: "Unknown",
        }),
        (classify.age_band, {
            -3.0: "18-29", 17.0: "18-29", 18.0: "18-29", 29.0: "18-29", 29.5: "30-39", 30.0: "30-39",
            39.0: "30-39", 40.0: "40-49", 49.0: "40-49", 50.0: "50-59", 59.0: "50-59", 60.0: "60+",
            99.0: "60+", None: "Unknown", NAN: "Unknown",
        }),
        (classify.valid_rating, {5.0: True, 0.0: False, 7.0: False, 4.5: False, None: False}),
        (classify.valid_recommendation, {1.0: True, 2.0: False, 0.0: True, 0.5: False, None: False}),
    ],
)
def test_labels(spark, build, cases):
    assert values(spark, "double", cases, build("x")) == list(cases.values())


def test_performance_band(spark):
    cases = {
        (20, 60): "Needs Attention", (15.3, 90): "Needs Attention", (12, 90): "Average", (10, 90): "Average",
        (7, 70): "Average", (7, 90): "Strong", (15, 90): "Needs Attention", (8, 82): "Strong",
    }
    frame = spark.createDataFrame([(float(n), float(r)) for n, r in cases], "n double, r double")
    found = frame.selectExpr(classify.performance_band("n", "r", "10D", "82D")).collect()
    assert [r[0] for r in found] == list(cases.values())


def test_priority(spark):
    cases = {
        (12, 8, 10): "High", (9, 8, 5): "High", (12, 8, 3): "Medium", (5, 8, 10): "Medium",
        (8, 8, 10): "Medium", (5, 8, 3): "Low", (8, 8, 4.9): "Low",
    }
    frame = spark.createDataFrame([tuple(map(float, k)) for k in cases], "a double, b double, s double")
    assert [r[0] for r in frame.selectExpr(classify.priority("a", "b", "s")).collect()] == list(cases.values())


@pytest.mark.parametrize(
    "expression, cases",
    [
        (classify.rating_cell("x", "4D"), {4.11: "Strong", 4.05: "Average", 3.75: "Needs Attention"}),
        (classify.recommendation_cell("x", "80D"), {82.0: "Strong", 76.0: "Average", 75.0: "Needs Attention"}),
        (classify.negative_cell("x", "10D"), {11.0: "Strong", 12.0: "Average", 15.0: "Needs Attention"}),
        (classify.relative_band("x", "4D"), {4.08: "Strong", 4.0: "Average", 3.8: "Needs Attention"}),
        (classify.relative_band("x", "0D"), {0.02: "Strong", 0.0: "Average", -0.05: "Needs Attention"}),
        (classify.relative_band("x", "4D", False), {3.9: "Strong", 4.3: "Needs Attention"}),
        (classify.absolute_band("x", "10D", False), {8.0: "Strong", 10.0: "Average", 15.0: "Needs Attention"}),
        (classify.missing_band("int(x)", "100"), {0.0: "Strong", 9.0: "Average", 10.0: "Needs Attention"}),
        (classify.completeness_band("x"), {99.0: "Strong", 90.0: "Average", 89.9: "Needs Attention"}),
        (classify.share_label("x"), {5.9: "", 6.0: "6.0%", 45.25: "45.3%"}),
        (classify.direction("x", True), {1.0: "improved", -1.0: "deteriorated", 1e-13: "unchanged"}),
        (classify.direction("x", False, "1e-9D"), {1.0: "deteriorated", -1.0: "improved", 1e-10: "unchanged"}),
        (classify.all_finite("x"), {1.0: True, INF: False, NAN: False, None: False}),
    ],
)
def test_bands(spark, expression, cases):
    assert values(spark, "double", cases, expression) == list(cases.values())


def test_rates_are_safe(spark):
    rows = [(1, 4), (0, 0), (5, 0), (None, 3)]
    frame = spark.createDataFrame(rows, "a int, b int")
    found = frame.selectExpr(numeric.rate("a", "b"), numeric.mean("a", "b")).collect()
    assert [tuple(r) for r in found] == [(25.0, 0.25), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_shares_of_counts_round_half_to_even_and_stay_within(spark):
    rows = [(5, 0.5), (7, 0.5), (1, 0.5), (3, 0.5), (10, 0.0), (10, 1.0), (0, 0.7), (2407, 0.6)]
    frame = spark.createDataFrame(rows, "n bigint, f double")
    assert [r[0] for r in frame.selectExpr(numeric.share_of("n", "f")).collect()] == [
        round(n * f) for n, f in rows
    ]


def test_numbers(spark):
    cases = {
        "5": 5.0, " 4.5 ": 4.5, "+1e2": 100.0, "-.5": -0.5, "3.": 3.0, "5d": None, "5f": None, "NaN": None,
        "Infinity": None, "inf": None, "five": None, "": None, None: None, "1_0": None, "1e999": None,
    }
    assert values(spark, "string", cases, numeric.to_number("x")) == list(cases.values())


def test_strip_and_word_count_follow_python(spark):
    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert set(spaces) == set(text.WHITESPACE)
    samples = [
        "three little words", "  padded   spacing  here ", "a b　c\u001fd", spaces, "", "one",
        "line\nbreak\r\nhere", "x" + spaces + "y", " wide ", "tab\tbed", "zero​width",
    ]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, x string").orderBy("i")
    found = frame.select(text.strip("x"), text.word_count("x")).collect()
    assert [tuple(r) for r in found] == [(s.strip(), len(s.split())) for s in samples]


def test_placeholders_have_no_words(spark):
    rows = [(" No Review Text ",), ("Untitled Review",), ("no review text",), (None,)]
    frame = spark.createDataFrame(rows, "x string")
    assert [r[0] for r in frame.select(text.word_count("x")).collect()] == [0, 0, 3, 0]


def test_cuts(spark):
    samples = ["s" * 70, "s" * 71, "e" * 260, "e" * 255 + "  " + "e" * 10, None]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, x string").orderBy("i")
    found = frame.select(text.sample_cell("x"), text.excerpt("x")).collect()
    assert found[0][0] == "s" * 70 and found[1][0] == "s" * 67 + "..."
    assert found[2][1] == "e" * 260 and found[3][1] == "e" * 255 + "..."
    assert found[4][0] is None


def test_strip_trims_every_kind_of_white_space(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions.text import WHITESPACE, strip

    cells = [a + b + c for a in ("", *WHITESPACE) for b in ("", "x", "~", "é", "a b", "\x7f") for c in ("", *WHITESPACE)] + [None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert all(r[0] == r[1] for r in df.select(strip("c"), F.btrim("c", F.lit(WHITESPACE))).collect())
    # Most texts are not passed over for it.
    assert "substring" in df.select(strip("c"))._jdf.queryExecution().optimizedPlan().toString()
