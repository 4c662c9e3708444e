"""Row filters over the clean table; every one is a predicate Spark can push down."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.numeric import rate
from tallyloom.functions.text import haystack

# Choices for text availability and for the scope of a scenario.
ALL_TEXTS, WITH_TEXT, WITHOUT_TEXT = "All records", "With review text only", "Without review text only"
SCOPES = {
    "All filtered data": None,
    "By Department": "department_name",
    "By Division": "division_name",
    "By Product Class": "class_name",
}


# Selections by name, and the columns whose values they list.
SELECTABLE = {
    "divisions": "division_name",
    "departments": "department_name",
    "classes": "class_name",
    "ratings": "rating",
    "sentiments": "sentiment",
    "recommendations": "recommendation_label",
    "age_bands": "age_band",
}


def needle(term: str | None) -> str:
    """What a search for a term looks for: in small letters, without blanks around; empty for a blank term."""
    return (term or "").strip().lower()


def holds(literal: str) -> Column:
    """Whether the text and title of a review hold a literal in any spelling of capitals."""
    return haystack("review_text", "title").contains(F.lit(literal))


def selection(has_review_text: str = ALL_TEXTS, keyword: str = "", **chosen: Iterable | None) -> Column:
    """All selections as one predicate; an empty or missing selection means no restriction."""
    if unknown := sorted(chosen.keys() - SELECTABLE.keys()):
        raise TypeError(f"There is no selection {', '.join(unknown)}; known are {', '.join(SELECTABLE)}.")
    listed = {SELECTABLE[name]: list(values) for name, values in chosen.items() if values is not None}
    if "rating" in listed:
        listed["rating"] = [float(int(stars)) for stars in listed["rating"]]
    parts = [F.col(column).isin(values) for column, values in listed.items() if values]
    if has_review_text in (WITH_TEXT, WITHOUT_TEXT):
        parts.append(F.col("has_review_text") == (has_review_text == WITH_TEXT))
    if literal := needle(keyword):
        parts.append(holds(literal))
    return reduce(and_, parts, F.lit(True))


def apply_filters(df: DataFrame, **choices) -> DataFrame:
    """Rows that meet every selection (see :func:`selection` for the names)."""
    return df.filter(selection(**choices))


def scope_size(df: DataFrame, **choices) -> DataFrame:
    """Rows the selections leave, all rows, and the share between them, in one pass."""
    return df.agg(
        F.count_if(F.coalesce(selection(**choices), F.lit(False))).alias("rows_in_scope"),
        F.count(F.lit(1)).alias("rows_total"),
    ).withColumn("share", F.expr(rate("rows_in_scope", "rows_total")))


def search_reviews(df: DataFrame, term: str) -> DataFrame:
    literal = needle(term)
    return df.filter(holds(literal)) if literal else df


def min_helpful_votes(df: DataFrame, votes: int) -> DataFrame:
    if votes <= 0:
        return df
    return df.filter(F.coalesce("positive_feedback_count", F.lit(0.0)) >= votes)


def negative_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sentiment") == "Negative")


def resolve_scope(df: DataFrame, scope: str, categories: Iterable[str] | None = None) -> DataFrame:
    """Rows of the chosen categories; all rows for an unknown scope or an empty choice."""
    column = SCOPES.get(scope)
    chosen = [str(c) for c in categories or [] if str(c).strip()]
    if column is None or not chosen:
        return df
    return df.filter(F.col(column).isin(*chosen) if column in df.columns else F.lit(False))

