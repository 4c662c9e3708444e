"""Lists of reviews: most helpful ones, searchable pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tallyloom.names import REVIEW_LIST, ROW_ID
from tallyloom.operators.filters import min_helpful_votes, negative_only as only_negative, search_reviews

# Sort choices of the review browser, column and direction.
SORTS = {
    "Helpful votes (high to low)": ("positive_feedback_count", False),
    "Rating (low to high)": ("rating", True),
    "Rating (high to low)": ("rating", False),
    "Review length (long to short)": ("review_length_words", False),
    "Age (young to old)": ("age", True),
    "Clothing ID": ("clothing_id", True),
}
DEFAULT_SORT = next(iter(SORTS))


def display_reviews(df: DataFrame, *extra: str) -> DataFrame:
    """The columns of a review list under their display names."""
    return df.select(
        *extra, *[F.col(c).alias(name) for c, name in REVIEW_LIST.items() if c in df.columns]
    )


def sort_key(sort: str) -> tuple[str, list[Column]]:
    column, ascending = SORTS[sort]
    key = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return column, [key, F.asc(ROW_ID)]


def most_helpful_reviews(df: DataFrame, top_n: int = 25, negative_only: bool = False) -> DataFrame:
    """Reviews with text by votes, then length, then file order; with their rank.

    ``orderBy`` with ``limit`` keeps only ``top_n`` rows per task, so the ranking window sees
    no more than that. Reviews with fewer votes than the last of the ``top_n`` most voted for can't
    be listed, so words are counted in the others only.
    """
    rows = df.filter("has_review_text")
    rows = only_negative(rows) if negative_only else rows
    rows = rows.withColumn(
        "positive_feedback_count", F.coalesce("positive_feedback_count", F.lit(0.0)).cast("bigint")
    )
    most = rows.select(F.col("positive_feedback_count").alias("votes")).orderBy(F.desc("votes")).limit(top_n)
    rows = rows.filter(F.col("positive_feedback_count") >= most.agg(F.min("votes")).scalar())
    order = [F.desc("positive_feedback_count"), F.desc("review_length_words"), F.asc(ROW_ID)]
    top = rows.orderBy(*order).limit(top_n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return display_reviews(ranked, "rank", ROW_ID).orderBy("rank")


def matching_reviews(
    df: DataFrame, term: str = "", negative_only: bool = False, min_votes: int = 0
) -> DataFrame:
    """Reviews with text that meet the browser's controls."""
    rows = search_reviews(df.filter("has_review_text"), term)
    rows = only_negative(rows) if negative_only else rows
    return min_helpful_votes(rows, min_votes)


def sorted_reviews(matches: DataFrame, sort: str = DEFAULT_SORT) -> DataFrame:
    """All matches in browsing order, missing values last (range-partitioned sort)."""
    return display_reviews(matches.orderBy(*sort_key(sort)[1]), ROW_ID)


def review_page(matches: DataFrame, page: int = 1, size: int = 25, sort: str = DEFAULT_SORT) -> DataFrame:
    """Rows of one page with their position among all matches.

    Meant for the first pages: each task keeps ``page * size`` rows. To go further, continue
    behind the last row of a page with :func:`review_page_after`, or read any page through an
    index (:mod:`tallyloom.operators.paging`).
    """
    start = (page - 1) * size
    order = sort_key(sort)[1]
    rows = matches.orderBy(*order).offset(start).limit(size)
    placed = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + start)
    return display_reviews(placed, "position", ROW_ID).orderBy("position")


def review_page_after(
    matches: DataFrame, last: Row | dict, size: int = 25, sort: str = DEFAULT_SORT
) -> DataFrame:
    """The ``size`` rows behind ``last``, which gives the sort column and ``row_id``.

    The cost does not grow with the depth of the page.
    """
    column, order = sort_key(sort)
    value = last[column] if column in last else last[REVIEW_LIST.get(column, column)]
    key, row = F.col(column), F.col(ROW_ID) > last[ROW_ID]
    if value is None:
        behind = key.isNull() & row
    else:
        beyond = key > value if SORTS[sort][1] else key < value
        behind = beyond | ((key == value) & row) | key.isNull()
    rows = matches.filter(behind).orderBy(*order).limit(size)
    placed = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    extra = [] if column in REVIEW_LIST else [column]
    return display_reviews(placed, "position", ROW_ID, *extra).orderBy("position")


def page_summary(matches: DataFrame, page: int = 1, size: int = 25) -> DataFrame:
    """Matches, number of pages, and the first and last position shown on ``page``."""
    start = (page - 1) * size
    n = F.col("matches")
    return matches.agg(F.count(F.lit(1)).alias("matches")).select(
        "matches",
        F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint").alias("pages"),
        F.lit(start + 1).cast("bigint").alias("first_row"),
        F.greatest(F.lit(start), F.least(n, F.lit(start + size))).cast("bigint").alias("last_row"),
    )
