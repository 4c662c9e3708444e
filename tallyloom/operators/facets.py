"""Values offered by each filter, following the choices made above it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tallyloom.names import AGE_BANDS, RECOMMENDATIONS, SENTIMENTS, UNKNOWN
from tallyloom.operators.filters import SCOPES, selection
from tallyloom.operators.shapes import empty, position

ORDERS = {
    "sentiment": SENTIMENTS,
    "recommendation": RECOMMENDATIONS,
    "age_band": (*AGE_BANDS, UNKNOWN),
}


def facet_values(
    df: DataFrame, divisions: Iterable[str] | None = None, departments: Iterable[str] | None = None
) -> DataFrame:
    """Distinct values of all seven facets from one scan: rows (facet, value, place).

    Departments follow the chosen divisions, classes follow both. Each row yields its facet
    values, which collapse before the shuffle because facets have few values.
    """
    in_division = selection(divisions=divisions)
    in_department = selection(departments=departments)
    offers = {
        "division": F.col("division_name"),
        "department": F.when(in_division, F.col("department_name")),
        "class": F.when(in_division & in_department, F.col("class_name")),
        # A fraction is dropped, as in the list of stars to choose from.
        "rating": F.col("rating").try_cast("bigint").cast("string"),
        **{
            facet: F.when(F.col(c).isin(*ORDERS[facet]), F.col(c))
            for facet, c in (
                ("sentiment", "sentiment"),
                ("recommendation", "recommendation_label"),
                ("age_band", "age_band"),
            )
        },
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in offers.items()])
    found = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
    # Canonical place for labels, numeric place for ratings, none (sort by name) for the rest.
    place = F.when(F.col("facet") == "rating", F.col("value").try_cast("int"))
    for facet, labels in ORDERS.items():
        place = place.when(F.col("facet") == facet, position("value", labels))
    return found.withColumn("place", place).orderBy("facet", "place", "value")


def keep_offered(facets: DataFrame, selected: dict[str, Iterable]) -> DataFrame:
    """The selections (facet, value) that are still offered."""
    chosen = [(facet, str(v)) for facet, values in selected.items() for v in values]
    if not chosen:
        return empty(facets, "facet string, value string")
    wanted = F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value")) for f, v in chosen])
    return facets.filter(F.array_contains(wanted, F.struct("facet", "value"))).select("facet", "value")


def available_categories(df: DataFrame, scope: str) -> DataFrame:
    """Sorted, non-blank labels of the scope's column; none for the whole-table scope."""
    column = SCOPES.get(scope)
    if column is None or column not in df.columns:
        return empty(df, "category string")
    labels = df.select(F.col(column).alias("category"))
    return labels.filter(F.trim("category") != "").distinct().orderBy("category")
