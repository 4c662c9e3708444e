"""Completeness, missing values, quality report and column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.classify import completeness_band, missing_band
from tallyloom.functions.numeric import rate
from tallyloom.functions.text import sample_cell, spelling
from tallyloom.names import (
    INDEX_COLUMNS,
    ROW_ID,
    TAXONOMY_COLUMNS,
    TEXT_PLACEHOLDER,
    TEXT_SPELLING,
    TITLE_PLACEHOLDER,
    UNKNOWN,
)
from tallyloom.operators.shapes import Text, as_value, exprs, record, unfold
from tallyloom.sources.schema_check import analysis_columns, source_columns


def _present_counts(raw: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rows and non-missing values per column in one row, with the names of the counts."""
    names = {c: f"present_{i}" for i, c in enumerate(analysis_columns(raw))}
    counts = raw.agg(*exprs("count(1) AS n", *[f"count(`{c}`) AS {name}" for c, name in names.items()]))
    return counts, names


def missing_values_by_field(raw: DataFrame) -> DataFrame:
    """Missing values per source column, most first."""
    counts, names = _present_counts(raw)
    records = [
        record(
            field=Text(c),
            rows="n",
            present=present,
            missing=f"n - {present}",
            missing_rate=rate(f"n - {present}", "n"),
            band=missing_band(f"(n - {present})", "n"),
        )
        for c, present in names.items()
    ]
    return unfold(counts, records).orderBy(F.desc("missing"), "field")


def column_completeness(raw: DataFrame) -> DataFrame:
    """Completeness per source column, worst first."""
    counts, names = _present_counts(raw)
    records = [
        record(
            column=Text(c),
            present=present,
            missing=f"n - {present}",
            completeness_rate=rate(present, "n"),
            band=completeness_band(rate(present, "n")),
        )
        for c, present in names.items()
    ]
    return unfold(counts, records).orderBy("completeness_rate", "column")


def completeness_metrics(raw: DataFrame) -> DataFrame:
    """Cells and rows without gaps, over the columns that came with the data."""
    columns = analysis_columns(raw)
    gaps = " + ".join(f"int(`{c}` IS NULL)" for c in columns) or "0"
    return (
        raw.selectExpr(f"{gaps} AS gaps")
        .agg(
            *exprs(
                f"count(1) * {len(columns)} AS total_cells",
                "coalesce(sum(gaps), 0L) AS missing_cells",
                "count_if(gaps = 0) AS complete_rows",
                "count(1) AS n",
            )
        )
        .selectExpr(
            "total_cells",
            "missing_cells",
            f"{rate('total_cells - missing_cells', 'total_cells')} AS completeness_rate",
            "complete_rows",
            f"{rate('complete_rows', 'n')} AS complete_row_rate",
        )
    )


def _level(column: str) -> str:
    return column.removesuffix("_name")


def data_quality_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """17 counts and rates describing the source table: one row.

    Of a clean table with spellings no text is moved to the duplicate flag.
    """
    texts = F.col(TEXT_SPELLING) if TEXT_SPELLING in clean.columns else spelling("review_text")
    unknown = [
        f"count_if({c} = '{UNKNOWN}') AS missing_{_level(c)}" if c in clean.columns else f"0L AS missing_{_level(c)}"
        for c in TAXONOMY_COLUMNS
    ]
    counts = clean.agg(
        *exprs(
            "count(1) AS total_rows",
            "count_if(NOT has_title) AS missing_titles",
            "count_if(NOT has_review_text) AS missing_review_texts",
            "count_if(is_duplicate_review_text) AS duplicate_review_rows",
            "count_if(NOT valid_rating) AS invalid_ratings",
            "count_if(NOT valid_recommendation) AS invalid_recommendations",
            *unknown,
        ),
        # Spellings count separately here, hence a digest of the text as it stands. All
        # other texts fall into one group (NULL) before the shuffle.
        F.count_distinct(F.when(F.col("is_duplicate_review_text"), texts)).alias("texts"),
    )
    return counts.withColumn("cells", as_value(completeness_metrics(raw))).selectExpr(
        "total_rows",
        f"{len(source_columns(clean))} AS total_columns",
        f"{len(source_columns(raw))} AS source_columns",
        "missing_titles",
        "missing_review_texts",
        "duplicate_review_rows",
        "texts AS duplicate_review_texts",
        "invalid_ratings",
        "invalid_recommendations",
        "cells.completeness_rate",
        "cells.complete_rows",
        "cells.complete_row_rate",
        "cells.missing_cells",
        "cells.total_cells",
        *[f"missing_{_level(c)}" for c in TAXONOMY_COLUMNS],
    )


def data_quality_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Issues with affected rows, severity, what they mean and what was done about them."""
    grave = lambda n: f"CASE WHEN {n} > 0 THEN 'High' ELSE 'None' END"
    either = lambda n, bad, good: f"CASE WHEN {n} > 0 THEN '{bad}' ELSE '{good}' END"
    issues = [
        ("Missing title", "missing_titles", Text("Low"),
         Text("Only lists of reviews show the title; no figure depends on it."),
         f"Filled with '{TITLE_PLACEHOLDER}'; has_title keeps the original state."),
        ("Missing review text", "missing_review_texts", Text("Medium"),
         Text("Such reviews cannot be listed or searched, but count in every rating figure."),
         f"Filled with '{TEXT_PLACEHOLDER}'; has_review_text keeps the original state."),
        *[
            (f"Missing {_level(c)} name", f"missing_{_level(c)}", Text("Low"),
             Text(f"These reviews form their own {_level(c)} group instead of enlarging a real one."),
             f"Filled with '{UNKNOWN}'.")
            for c in TAXONOMY_COLUMNS
        ],
        ("Repeated review text", "duplicate_review_rows", Text("Low"),
         "concat(format_number(duplicate_review_texts, 0), ' texts occur more than once and would be listed repeatedly.')",
         "Flagged, never deleted: customers may use the same words."),
        ("Invalid rating", "invalid_ratings", grave("invalid_ratings"),
         either("invalid_ratings", "Sentiment and the average rating are distorted.",
                "None found: every rating is one of 1 to 5."),
         "Marked in valid_rating."),
        ("Invalid recommendation flag", "invalid_recommendations", grave("invalid_recommendations"),
         either("invalid_recommendations", "The recommendation rate is distorted.",
                "None found: every flag is 0 or 1."),
         "Marked in valid_recommendation."),
    ]
    if any(c in INDEX_COLUMNS for c in raw.columns):
        issues.append(
            ("Export index column", "total_rows", Text("Info"),
             Text("Could be mistaken for a measure."), "Dropped.")
        )
    return unfold(
        data_quality_summary(raw, clean),
        [
            record(
                position=i,
                issue=Text(issue),
                affected_rows=rows,
                percentage=rate(rows, "total_rows"),
                severity=severity,
                impact=impact,
                treatment=Text(treatment),
            )
            for i, (issue, rows, severity, impact, treatment) in enumerate(issues, start=1)
        ],
    ).orderBy("position")


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, gaps, distinct values and first value of every column.

    Distinct values are counted over digests: each row yields one (column, digest) pair per
    value, pairs collapse before the shuffle, and no text travels. With ``exact=False`` they are
    estimated in the same pass as everything else, with a relative standard deviation of 2 %.
    """
    columns = dict(enumerate(source_columns(df)))
    kinds = dict(df.dtypes)
    # Cut before aggregating, so that the buffer holds a sample and not a whole text.
    samples = [
        F.min_by(sample_cell(F.expr(f"string(`{c}`)")), F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN {ROW_ID} END")).alias(f"sample_{i}")
        for i, c in columns.items()
    ]
    estimates = [] if exact else [f"approx_count_distinct(`{c}`, 0.02D) AS unique_{i}" for i, c in columns.items()]
    counts = df.agg(
        *exprs("count(1) AS n", *[f"count(`{c}`) AS present_{i}" for i, c in columns.items()], *estimates), *samples
    )
    pairs = ", ".join(
        f"named_struct('at', {i}, 'value', unhex(sha2(string(`{c}`), 256)))" for i, c in columns.items()
    )
    if exact:
        distinct = (
            df.selectExpr(f"inline(array({pairs}))")
            .filter("value IS NOT NULL")
            .distinct()
            .agg(*exprs(*[f"count_if(at = {i}) AS unique_{i}" for i in columns]))
        )
        counts = counts.withColumn("distinct", as_value(distinct))
    unique = "`distinct`.unique_" if exact else "unique_"
    return unfold(
        counts,
        [
            record(
                column=Text(c),
                dtype=Text(kinds[c]),
                non_null=f"present_{i}",
                missing=f"n - present_{i}",
                missing_rate=rate(f"n - present_{i}", "n"),
                unique=f"{unique}{i}",
                sample=f"coalesce(sample_{i}, '')",
            )
            for i, c in columns.items()
        ],
    )
