"""Volume, satisfaction and advocacy per segment.

Everything here starts from *sums*: one row per segment with additive measures only. Rates,
shares and overall baselines are arithmetic on the sums, so one scan and one shuffle of a few
rows per task serve them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions import classify
from tallyloom.functions.numeric import identifier, mean, rate
from tallyloom.names import AGE_BANDS, UNKNOWN
from tallyloom.operators.shapes import as_value, empty, exprs, position

SUMS = {
    "reviews": "count(1)",
    "rating_sum": "sum(rating)",
    "rated": "count(rating)",
    "flagged": "count(recommended_ind)",
    "recommended": "count_if(recommended_ind = 1)",
    "not_recommended": "count_if(recommended_ind = 0)",
    "positive": "count_if(sentiment = 'Positive')",
    "neutral": "count_if(sentiment = 'Neutral')",
    "negative": "count_if(sentiment = 'Negative')",
    "votes": "sum(coalesce(positive_feedback_count, 0D))",
    "with_text": "count_if(has_review_text)",
}
CLASSIFIED = "(positive + neutral + negative)"
# Measure -> its type and how it comes out of the sums; ``whole`` holds the overall sums.
MEASURES = {
    "reviews": ("bigint", "reviews"),
    "share": ("double", rate("reviews", "whole.reviews")),
    "avg_rating": ("double", mean("rating_sum", "rated")),
    "recommended_reviews": ("bigint", "recommended"),
    "not_recommended_reviews": ("bigint", "not_recommended"),
    # Any given flag counts here, also one outside 0 and 1.
    "recommendation_rate": ("double", rate("recommended", "flagged")),
    "positive_reviews": ("bigint", "positive"),
    "positive_rate": ("double", rate("positive", CLASSIFIED)),
    "neutral_reviews": ("bigint", "neutral"),
    "neutral_rate": ("double", rate("neutral", CLASSIFIED)),
    "negative_reviews": ("bigint", "negative"),
    "negative_rate": ("double", rate("negative", CLASSIFIED)),
    "helpful_votes": ("bigint", "bigint(votes)"),
    "avg_helpful_votes": ("double", mean("votes", "reviews")),
    "reviews_with_text": ("bigint", "with_text"),
}
# Overall rates out of ``whole``, by the rules of the headline KPIs.
BASELINES = {
    "avg_rating": mean("whole.rating_sum", "whole.rated"),
    "negative_rate": rate("whole.negative", "whole.positive + whole.neutral + whole.negative"),
    "recommendation_rate": rate("whole.recommended", "whole.recommended + whole.not_recommended"),
}
# Columns that hold labels: the product taxonomy and what cleaning derives.
DIMENSIONS = ("division_name", "department_name", "class_name", "age_band")
BAND_ORDER = (*AGE_BANDS, UNKNOWN)


def segment_sums(df: DataFrame, *by: str) -> DataFrame:
    """Additive measures per combination of ``by`` (one row for none)."""
    keys = [F.col(identifier(c)).alias(c) for c in by]
    return df.groupBy(*keys).agg(*exprs(*[f"{total} AS {name}" for name, total in SUMS.items()]))


def with_whole(sums: DataFrame) -> DataFrame:
    """Add the sums of all segments as the struct ``whole``, before any segment is left out.

    The total is a distributed aggregate of the segment table, whatever the column.
    """
    totals = sums.agg(*exprs(*[f"coalesce(sum({c}), 0) AS {c}" for c in SUMS]))
    return sums.withColumn("whole", as_value(totals))


def with_measures(sums: DataFrame, *by: str) -> DataFrame:
    """Segment table with the ``whole`` struct kept for baselines."""
    measures = [f"{how} AS {name}" for name, (_, how) in MEASURES.items()]
    return with_whole(sums).selectExpr(*[identifier(c) for c in by], *measures, "whole")


def segment_table(df: DataFrame, by: str, min_reviews: int = 0) -> DataFrame:
    """Unsorted segment table with ``whole``; too small segments are left out, not merged."""
    table = with_measures(segment_sums(df, by), by)
    return table.filter(f"reviews >= {min_reviews}") if min_reviews > 0 else table


def segment_performance(
    df: DataFrame,
    by: str,
    min_reviews: int = 0,
    order: Sequence[str] | None = None,
    sort_by: str | None = "reviews",
) -> DataFrame:
    """15 measures per value of ``by``, in a given label order or by a measure, descending."""
    if by not in df.columns:
        columns = {identifier(by): "string"} | {name: kind for name, (kind, _) in MEASURES.items()}
        return empty(df, ", ".join(f"{c} {kind}" for c, kind in columns.items()))
    table = segment_table(df, by, min_reviews).drop("whole")
    if order is not None:
        return table.orderBy(position(identifier(by), order), F.col(identifier(by)))
    if sort_by in MEASURES:
        return table.orderBy(F.desc(sort_by), F.col(identifier(by)))
    return table


def division_performance(df: DataFrame, min_reviews: int = 0) -> DataFrame:
    return segment_performance(df, "division_name", min_reviews)


def department_performance(df: DataFrame, min_reviews: int = 0) -> DataFrame:
    return segment_performance(df, "department_name", min_reviews)


def age_band_performance(df: DataFrame, min_reviews: int = 0) -> DataFrame:
    return segment_performance(df, "age_band", min_reviews, order=BAND_ORDER)


def all_segments(df: DataFrame, min_reviews: int = 0) -> DataFrame:
    """Segment tables of all four dimensions from one scan: rows (dimension, segment, ...).

    Rows collapse to combinations of the dimensions first; only those few are then counted
    once per dimension.
    """
    pairs = ", ".join(f"named_struct('dimension', '{d}', 'segment', {d})" for d in DIMENSIONS)
    sums = (
        segment_sums(df, *DIMENSIONS)
        .selectExpr(f"inline(array({pairs}))", *SUMS)
        .groupBy("dimension", "segment")
        .agg(*exprs(*[f"sum({c}) AS {c}" for c in SUMS]))
        # The segments of each dimension add up to the whole table.
        .selectExpr("*", "named_struct('reviews', sum(reviews) OVER (PARTITION BY dimension)) AS whole")
    )
    table = sums.selectExpr(
        "dimension", "segment", *[f"{how} AS {name}" for name, (_, how) in MEASURES.items()]
    )
    if min_reviews > 0:
        table = table.filter(f"reviews >= {min_reviews}")
    return table.orderBy("dimension", F.desc("reviews"), "segment")


def top_classes_by_volume(df: DataFrame, top_n: int = 10) -> DataFrame:
    table = segment_table(df, "class_name").drop("whole")
    return table.orderBy(F.desc("reviews"), "class_name").limit(top_n)


def worst_classes(df: DataFrame, min_reviews: int = 0, top_n: int = 15) -> DataFrame:
    """Classes by negative rate, with the overall rate and the band of the gap to it."""
    base = BASELINES["negative_rate"]
    return (
        segment_table(df, "class_name", min_reviews)
        .selectExpr(
            "class_name", "reviews", "negative_reviews", "negative_rate",
            f"{base} AS baseline_negative_rate",
            f"{classify.absolute_band('negative_rate', base, high_is_good=False)} AS band",
        )
        .orderBy(F.desc("negative_rate"), "class_name")
        .limit(top_n)
    )


def class_performance_matrix(
    df: DataFrame, min_reviews: int = 50, top_n: int | None = None, cell_bands: bool = False
) -> DataFrame:
    """Product classes against the overall figures of the same rows."""
    rating, negative, advocacy = (
        BASELINES[c] for c in ("avg_rating", "negative_rate", "recommendation_rate")
    )
    performance = classify.performance_band(
        "negative_rate", "recommendation_rate", negative, advocacy
    )
    bands = [
        f"{classify.rating_cell('avg_rating', rating)} AS rating_band",
        f"{classify.recommendation_cell('recommendation_rate', advocacy)} AS recommendation_band",
        f"{classify.negative_cell('negative_rate', negative)} AS negative_band",
    ]
    table = (
        segment_table(df, "class_name", min_reviews)
        .selectExpr(
            "class_name AS product_class", "reviews AS review_count", "avg_rating",
            "recommended_reviews", "recommendation_rate", "negative_reviews", "negative_rate",
            "helpful_votes AS total_helpful_votes", f"{performance} AS performance",
            *(bands if cell_bands else []),
        )
        .orderBy(F.desc("review_count"), "product_class")
    )
    return table.limit(top_n) if top_n else table


def department_vs_baseline(df: DataFrame, min_reviews: int = 0) -> DataFrame:
    """Departments with rating and recommendation rate next to the overall ones."""
    rating, advocacy = BASELINES["avg_rating"], BASELINES["recommendation_rate"]
    return (
        segment_table(df, "department_name", min_reviews)
        .selectExpr(
            "department_name", "reviews", "avg_rating", "recommendation_rate",
            f"{rating} AS baseline_rating",
            f"{advocacy} AS baseline_recommendation_rate",
            f"{classify.relative_band('avg_rating', rating)} AS rating_band",
            f"{classify.absolute_band('recommendation_rate', advocacy)} AS recommendation_band",
        )
        .orderBy(F.desc("reviews"), "department_name")
    )


def segment_overview(df: DataFrame, by: str, min_reviews: int = 0) -> DataFrame:
    """Segment table with the rating on a 0-100 scale, to share an axis with rates."""
    return segment_performance(df, by, min_reviews).selectExpr("*", "avg_rating * 20 AS rating_on_100")


def advocacy_vs_criticism(df: DataFrame, top_n: int = 8) -> DataFrame:
    """Recommendation and negative rate of the largest classes, long form."""
    return (
        top_classes_by_volume(df, top_n)
        .unpivot(
            ["class_name", "reviews"],
            ["recommendation_rate", "negative_rate"], "measure", "rate",
        )
        .orderBy(F.desc("reviews"), "class_name", F.desc("measure"))
    )


def helpful_votes_by_class(df: DataFrame, top_n: int = 10) -> DataFrame:
    return (
        segment_table(df, "class_name")
        .selectExpr(
            "class_name AS product_class", "reviews", "helpful_votes", "avg_helpful_votes",
            "negative_rate", "avg_rating",
        )
        .orderBy(F.desc("helpful_votes"), "product_class")
        .limit(top_n)
    )
