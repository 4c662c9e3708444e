"""The cleaning pipeline. Rows are kept as they are; columns are filled or added."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions import classify, text
from tallyloom.names import (
    INDEX_COLUMNS,
    TAXONOMY_COLUMNS,
    TEXT_KEY,
    TEXT_PLACEHOLDER,
    TEXT_SPELLING,
    TITLE_PLACEHOLDER,
    UNKNOWN,
)
from tallyloom.operators.duplicates import flag_duplicate_review_text
from tallyloom.operators.shapes import Text, record, unfold


def drop_index_column(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in INDEX_COLUMNS])


def flag_text_availability(df: DataFrame) -> DataFrame:
    """Has to come before any placeholder is written."""
    return df.withColumns(
        {
            "has_review_text": F.col("review_text").isNotNull(),
            "has_title": F.col("title").isNotNull(),
        }
    )


def fill_missing(df: DataFrame) -> DataFrame:
    fills = {"title": TITLE_PLACEHOLDER, "review_text": TEXT_PLACEHOLDER}
    fills |= {c: UNKNOWN for c in TAXONOMY_COLUMNS}
    return df.na.fill({c: v for c, v in fills.items() if c in df.columns})


def validate_domains(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "valid_rating": F.expr(classify.valid_rating("rating")),
            "valid_recommendation": F.expr(classify.valid_recommendation("recommended_ind")),
        }
    )


def add_labels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "sentiment": F.expr(classify.sentiment("rating")),
            "recommendation_label": F.expr(classify.recommendation_label("recommended_ind")),
            "age_band": F.expr(classify.age_band("age")),
        }
    )


def add_lengths(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "review_length_words": text.word_count("review_text"),
            "title_length_words": text.word_count("title"),
        }
    )


def clean_rows(raw: DataFrame) -> DataFrame:
    """Everything that needs the row alone (also works on a streaming DataFrame)."""
    return (
        raw.transform(drop_index_column)
        .transform(flag_text_availability)
        .transform(fill_missing)
        .transform(validate_domains)
        .transform(add_labels)
        .transform(add_lengths)
    )


def clean_reviews(raw: DataFrame, spellings: bool = False) -> DataFrame:
    """Raw table to clean table, with the duplicate flag.

    ``spellings`` adds a digest of each text as it stands, for views that need it besides the flag.
    """
    rows = raw.transform(clean_rows)
    if spellings:
        rows = rows.withColumn(TEXT_SPELLING, text.spelling("review_text"))
    return rows.transform(flag_duplicate_review_text).drop(TEXT_KEY)


def clean_dataset(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    clean = clean_reviews(raw)
    return clean, cleaning_audit(raw, clean)


def analysis_ready(clean: DataFrame) -> DataFrame:
    """Rows fit for showing and searching texts."""
    return clean.filter(
        F.col("has_review_text") & F.col("valid_rating") & (F.col("sentiment") != UNKNOWN)
    )


def cleaning_audit(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """What each cleaning step touched: 13 rows out of one aggregate per table."""
    had_index = any(c in INDEX_COLUMNS for c in raw.columns)
    gaps = " + ".join(f"count_if({c} IS NULL)" for c in TAXONOMY_COLUMNS if c in raw.columns)
    counts = clean.agg(
        F.expr("count(1)").alias("n"),
        F.expr("count_if(has_review_text)").alias("texts"),
        F.expr("count_if(NOT has_review_text)").alias("no_text"),
        F.expr("count_if(NOT has_title)").alias("no_title"),
        F.expr("count_if(NOT valid_rating)").alias("bad_rating"),
        F.expr("count_if(NOT valid_recommendation)").alias("bad_flag"),
        F.expr("count_if(is_duplicate_review_text)").alias("duplicates"),
    ).withColumn("gaps", raw.agg(F.expr(gaps or "0L").alias("gaps")).scalar())
    steps = [
        ("Remove export index", "Index column dropped" if had_index else "No index column found",
         "n" if had_index else "0L",
         "A row number from the export says nothing about a review."),
        ("Note text availability", "has_review_text and has_title added", "no_text + no_title",
         "Taken before filling, so that filled rows can still be told apart."),
        ("Fill titles", f"NULL became '{TITLE_PLACEHOLDER}'", "no_title",
         "A review without a headline is still a review."),
        ("Fill review texts", f"NULL became '{TEXT_PLACEHOLDER}'", "no_text",
         "The rating counts even when nothing was written."),
        ("Fill product taxonomy", f"NULL became '{UNKNOWN}'", "gaps",
         "Gaps form a group of their own rather than joining a real one."),
        ("Check ratings", "valid_rating added: one of 1 to 5", "bad_rating",
         "Sentiment is read off the rating."),
        ("Check recommendation flags", "valid_recommendation added: 0 or 1", "bad_flag",
         "Rates need a two-valued flag."),
        ("Derive sentiment", "1-2 Negative, 3 Neutral, 4-5 Positive", "n",
         "One shared reading of the star scale."),
        ("Derive recommendation label", "1 Recommended, 0 Not Recommended", "n",
         "Readable groups for tables."),
        ("Derive age band", "Ten-year bands from 18-29 to 60+", "n",
         "Bands have enough reviews to compare."),
        ("Count words", "Whitespace-separated words; placeholders have none", "n",
         "Length shows how much effort went into a review."),
        ("Flag repeated texts", "is_duplicate_review_text added", "duplicates",
         "Two customers may write the same words; nothing is deleted."),
        ("Limit text display", None, "no_text",
         "Only rows with a text are listed and searched; all rows are counted."),
    ]
    shown = "concat(format_number(texts, 0), ' reviews have a text to show')"
    return unfold(
        counts,
        [
            record(
                step=i,
                name=Text(name),
                action=shown if action is None else Text(action),
                rows_affected=rows,
                rationale=Text(why),
            )
            for i, (name, action, rows, why) in enumerate(steps, start=1)
        ],
    ).orderBy("step")
