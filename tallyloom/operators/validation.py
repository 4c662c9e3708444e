"""Compare calculated KPIs with expected figures."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from tallyloom.functions.numeric import double
from tallyloom.operators.kpis import compute_kpis
from tallyloom.operators.shapes import Text, exprs, record, unfold


class Expectation(NamedTuple):
    kpi: str
    label: str
    expected: float
    tolerance: float = 0.0
    kind: str = "count"


# Published figures of the original review file (23,486 rows).
PUBLISHED = (
    Expectation("total_records", "Total Reviews", 23486),
    Expectation("records_with_text", "Reviews With Text", 22641),
    Expectation("missing_review_text", "Missing Review Text", 845),
    Expectation("missing_title", "Missing Titles", 3810),
    Expectation("average_rating", "Average Rating", 4.196, 0.01, "rating"),
    Expectation("recommendation_rate", "Recommendation Rate", 82.24, 0.15, "percent"),
    Expectation("positive_reviews", "Positive Reviews", 18208),
    Expectation("positive_rate", "Positive Rate", 77.53, 0.15, "percent"),
    Expectation("neutral_reviews", "Neutral Reviews", 2871),
    Expectation("neutral_rate", "Neutral Rate", 12.22, 0.15, "percent"),
    Expectation("negative_reviews", "Negative Reviews", 2407),
    Expectation("negative_rate", "Negative Rate", 10.25, 0.15, "percent"),
    Expectation("total_positive_feedback", "Total Positive Feedback Count", 59559),
    Expectation("average_age", "Average Age", 43.20, 0.1, "rating"),
    Expectation("median_age", "Median Age", 41),
)

DECIMALS = {"count": 0, "rating": 3, "percent": 2}


def _shown(value: str, kind: str) -> str:
    text = f"format_number({value}, {DECIMALS[kind]})"
    return f"concat({text}, '%')" if kind == "percent" else text


def validation_table(df: DataFrame, expectations: Sequence[Expectation] = PUBLISHED) -> DataFrame:
    """One row per expected figure. ``df`` has to be the clean table before any filter."""
    records = []
    for e in expectations:
        actual, expected = f"coalesce(double({e.kpi}), 0D)", double(e.expected)
        delta = f"({actual} - {expected})"
        passed = f"abs({delta}) <= {double(e.tolerance)}" if e.tolerance else f"{actual} = {expected}"
        decimals = 3 if e.tolerance else 0
        records.append(
            record(
                metric=Text(e.label),
                calculated=actual,
                expected=expected,
                difference=delta,
                status=f"CASE WHEN {passed} THEN 'Match' ELSE 'Deviation' END",
                passed=passed,
                calculated_text=_shown(actual, e.kind),
                expected_text=_shown(expected, e.kind),
                difference_text=f"concat(CASE WHEN {delta} < 0 THEN '-' ELSE '+' END, format_number(abs({delta}), {decimals}))",
            )
        )
    return unfold(compute_kpis(df), records)


def validation_summary(df: DataFrame, expectations: Sequence[Expectation] = PUBLISHED) -> DataFrame:
    """How many expectations hold, and which do not."""
    table = validation_table(df, expectations)
    return table.agg(
        *exprs(
            "count(1) AS checks",
            "count_if(passed) AS passed",
            "count_if(NOT passed) AS failed",
            "array_sort(collect_list(CASE WHEN NOT passed THEN metric END)) AS failed_metrics",
            "coalesce(bool_and(passed), true) AS all_passed",
        )
    )
