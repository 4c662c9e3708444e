"""Shapes most operators share: one row unfolded into several, a one-row table as a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.numeric import quoted


def exprs(*texts: str) -> list[Column]:
    """SQL texts as Columns, for ``agg``."""
    return [F.expr(text) for text in texts]


class Text(str):
    """A plain text in a record, as opposed to an SQL expression."""


def record(**fields) -> str:
    """A struct as SQL text. Strings are expressions, :class:`Text` and numbers are literals."""

    def sql(value) -> str:
        if isinstance(value, Text):
            return quoted(value)
        return "NULL" if value is None else str(value)

    return f"named_struct({', '.join(f'{quoted(k)}, {sql(v)}' for k, v in fields.items())})"


def unfold(one_row: DataFrame, records: Sequence[str]) -> DataFrame:
    """One row into as many as there are records; NULL records are left out."""
    return one_row.selectExpr(f"filter(array({', '.join(records)}), r -> r IS NOT NULL) AS rows").selectExpr(
        "inline(rows)"
    )


def as_value(one_row: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery (NULL when there is no row)."""
    return one_row.select(F.struct("*").alias("value")).scalar()


def position(column: str, labels: Sequence) -> Column:
    """1-based place of a label in ``labels``, one past the end for all others."""
    places = f"array_position(array({', '.join(quoted(v) for v in labels)}), {column})"
    return F.expr(f"int(coalesce(nullif({places}, 0), {len(labels) + 1}))")


def empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)
