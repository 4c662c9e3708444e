"""Compare a table's columns with the review schema: driver-side metadata, no job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.numeric import quoted
from tallyloom.names import INDEX_COLUMNS, REQUIRED_COLUMNS, ROW_ID, TEXT_KEY, TEXT_SPELLING


class DatasetError(RuntimeError):
    """A dataset cannot be read, or lacks the columns the operators need."""


@dataclass(frozen=True)
class SchemaReport:
    columns: tuple[str, ...]
    missing_required: tuple[str, ...]
    unexpected: tuple[str, ...]
    has_index_column: bool

    @property
    def is_usable(self) -> bool:
        return not self.missing_required

    @property
    def is_expected_schema(self) -> bool:
        return self.is_usable and not self.unexpected

    def messages(self) -> list[str]:
        notes = (
            ("Required columns not found", self.missing_required),
            ("Columns outside the review schema, passed through unused", self.unexpected),
        )
        return [f"{text}: {', '.join(names)}" for text, names in notes if names]


def source_columns(df: DataFrame) -> list[str]:
    """The columns that came with the data, without the ones added at ingestion."""
    return [c for c in df.columns if c not in (ROW_ID, TEXT_KEY, TEXT_SPELLING)]


def analysis_columns(df: DataFrame) -> list[str]:
    return [c for c in source_columns(df) if c not in INDEX_COLUMNS]


def describe_schema(df: DataFrame) -> SchemaReport:
    columns = source_columns(df)
    return SchemaReport(
        columns=tuple(columns),
        missing_required=tuple(c for c in REQUIRED_COLUMNS if c not in columns),
        unexpected=tuple(c for c in analysis_columns(df) if c not in REQUIRED_COLUMNS),
        has_index_column=any(c in INDEX_COLUMNS for c in columns),
    )


def replace_if_usable(current: DataFrame, candidate: DataFrame) -> tuple[DataFrame, SchemaReport]:
    """The candidate when it has all required columns, else the current table."""
    report = describe_schema(candidate)
    return (candidate if report.is_usable else current), report


def property_sheet(df: DataFrame, source_name: str) -> DataFrame:
    """What was loaded, as rows (property, value)."""
    report = describe_schema(df)
    facts = {
        "Source": source_name,
        "Rows": None,
        "Source columns": str(len(report.columns)),
        "Matches expected schema": "Yes" if report.is_expected_schema else "No",
        "Missing required columns": ", ".join(report.missing_required) or "None",
        "Unrecognised columns": ", ".join(report.unexpected) or "None",
    }
    rows = [
        f"named_struct('property', {quoted(k)}, 'value', {'string(n)' if v is None else quoted(v)})"
        for k, v in facts.items()
    ]
    return df.agg(F.count(F.lit(1)).alias("n")).selectExpr(f"inline(array({', '.join(rows)}))")
