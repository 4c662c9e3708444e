"""From cells as read (all text) to the typed raw review table. No row is ever dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.numeric import finite, to_number
from tallyloom.functions.text import blank_to_null, missing_token_to_null
from tallyloom.names import NUMERIC_COLUMNS, SOURCE_COLUMNS, TEXT_COLUMNS


def rename_source_columns(df: DataFrame) -> DataFrame:
    """Header names to the names used here; other columns keep theirs."""
    return df.withColumnsRenamed({k: v for k, v in SOURCE_COLUMNS.items() if k in df.columns})


def null_missing_tokens(df: DataFrame) -> DataFrame:
    """Cells that spell a missing value become NULL (text columns only, exact match)."""
    texts = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: missing_token_to_null(F.col(f"`{c}`")) for c in texts})


def coerce_types(df: DataFrame) -> DataFrame:
    """Numbers to DOUBLE (bad ones to NULL), texts trimmed (blank ones to NULL)."""
    kinds = dict(df.dtypes)
    columns = {}
    for c in NUMERIC_COLUMNS:
        if c in kinds:
            columns[c] = F.expr(to_number(c) if kinds[c] == "string" else finite(f"double({c})"))
    for c in TEXT_COLUMNS:
        if c in kinds:
            columns[c] = blank_to_null(F.col(c).cast("string"))
    return df.withColumns(columns)
