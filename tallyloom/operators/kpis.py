"""Headline figures of a clean table: one row, 23 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.functions.numeric import mean, rate
from tallyloom.operators.shapes import exprs

# Names and order of the KPIs.
KPI_COLUMNS = (
    "total_records", "records_with_text", "missing_review_text", "missing_title",
    "text_coverage_rate", "average_rating", "median_rating", "recommendation_rate",
    "recommended_count", "not_recommended_count", "positive_reviews", "positive_rate",
    "neutral_reviews", "neutral_rate", "negative_reviews", "negative_rate",
    "total_positive_feedback", "average_positive_feedback", "average_age", "median_age",
    "average_review_length", "duplicate_review_rows", "unique_clothing_ids",
)


def compute_kpis(df: DataFrame, exact: bool = True) -> DataFrame:
    """All KPIs from one aggregation plus one distinct count.

    Rows are first summed per (rating, age): few groups, plain hash aggregation, and exactly
    the frequencies both medians need. Products are counted on a branch of their own that
    reads a single column, since a distinct count in the same aggregate would split every
    other measure by product. ``exact=False`` estimates it, with a relative standard deviation
    of 2 %, instead of shuffling every product.
    """
    given = set(df.columns)
    optional = lambda c, otherwise: c if c in given else otherwise
    valid = optional("valid_recommendation", "true")
    counted = {
        "n": "true",
        "texts": "has_review_text",
        "titles": optional("has_title", "true"),
        "flags": f"{valid} AND recommended_ind IS NOT NULL",
        "yes": f"{valid} AND recommended_ind = 1",
        "no": f"{valid} AND recommended_ind = 0",
        "pos": "sentiment = 'Positive'",
        "neu": "sentiment = 'Neutral'",
        "neg": "sentiment = 'Negative'",
        "voted": "positive_feedback_count IS NOT NULL",
        "repeats": optional("is_duplicate_review_text", "false"),
    }
    cells = df.selectExpr(
        "rating", "age", "positive_feedback_count AS votes",
        "CASE WHEN has_review_text THEN bigint(review_length_words) END AS words",
        *[f"{condition} AS {name}" for name, condition in counted.items()],
    )
    cells = cells.groupBy("rating", "age").agg(
        *exprs(
            "sum(votes) AS votes", "sum(words) AS words",
            *[f"count_if({name}) AS {name}" for name in counted],
        )
    )
    median = lambda c: f"percentile({c}, 0.5D, CASE WHEN {c} IS NULL THEN 0L ELSE n END)"
    sums = cells.agg(
        *exprs(
            *[f"coalesce(sum({name}), 0L) AS {name}" for name in (*counted, "words")],
            "coalesce(sum(votes), 0D) AS votes",
            *[
                f"{measure} AS {c}_{kind}"
                for c in ("rating", "age")
                for kind, measure in (
                    ("sum", f"sum({c} * n)"),
                    ("count", f"sum(CASE WHEN {c} IS NOT NULL THEN n END)"),
                    ("median", median(c)),
                )
            ],
        )
    )
    ids = df.select("clothing_id")
    products = (
        ids.distinct().agg(*exprs("count(clothing_id) AS n"))
        if exact
        else ids.agg(*exprs("approx_count_distinct(clothing_id, 0.02D) AS n"))
    )
    classified = "(pos + neu + neg)"
    return sums.withColumn("products", products.scalar()).selectExpr(
        "n AS total_records",
        "texts AS records_with_text",
        "n - texts AS missing_review_text",
        "n - titles AS missing_title",
        f"{rate('texts', 'n')} AS text_coverage_rate",
        f"{mean('rating_sum', 'rating_count')} AS average_rating",
        # An empty table has medians of 0; a table without any value has none.
        "CASE WHEN n = 0 THEN 0D ELSE rating_median END AS median_rating",
        f"{rate('yes', 'flags')} AS recommendation_rate",
        "yes AS recommended_count",
        "no AS not_recommended_count",
        "pos AS positive_reviews",
        f"{rate('pos', classified)} AS positive_rate",
        "neu AS neutral_reviews",
        f"{rate('neu', classified)} AS neutral_rate",
        "neg AS negative_reviews",
        f"{rate('neg', classified)} AS negative_rate",
        "bigint(votes) AS total_positive_feedback",
        f"{mean('votes', 'voted')} AS average_positive_feedback",
        f"{mean('age_sum', 'age_count')} AS average_age",
        "CASE WHEN n = 0 THEN 0D ELSE age_median END AS median_age",
        f"{mean('words', 'texts')} AS average_review_length",
        "repeats AS duplicate_review_rows",
        "products AS unique_clothing_ids",
    )


def largest_vote_count(df: DataFrame) -> DataFrame:
    """Upper bound for a minimum-votes filter."""
    return df.agg(*exprs("bigint(coalesce(max(positive_feedback_count), 0)) AS largest_vote_count"))


def domain_validity(df: DataFrame) -> DataFrame:
    """Whether all ratings and flags are in their domains, with the counts of those that are not."""
    return df.agg(
        *exprs(
            "count_if(NOT valid_rating) AS invalid_ratings",
            "count_if(NOT valid_recommendation) AS invalid_recommendations",
            "count_if(NOT valid_rating OR NOT valid_recommendation) = 0 AS passed",
        )
    )
