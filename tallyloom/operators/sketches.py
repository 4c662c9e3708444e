"""Mergeable sketches per cell of a layer: medians, quartiles and distinct counts without its reviews.

A cell is a combination of the columns in ``CELL``. Each has a quantile sketch (KLL) per measure and
a distinct-count sketch (HyperLogLog) per key column. Sketches of cells, and of parts of a layer,
merge, so any selection of cells, by any of these columns, is answered from the stored table.

Errors: the rank of an estimated quantile is off by at most ``RANK_ERROR`` of the values, with a
probability of 99 %; a cell of fewer than ``K`` values is exact. A distinct count has a relative
standard error of ``DISTINCT_ERROR``, and is exact for few values. Both hold after merging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.numeric import identifier

CELL = ("division_name", "department_name", "class_name", "age_band", "sentiment", "recommendation_label")
# Measures as in the numeric summary; the length counts where there is a text.
MEASURES = {
    "rating": F.col,
    "age": F.col,
    "positive_feedback_count": F.col,
    "review_length_words": lambda c: F.when(F.col("has_review_text"), F.col(c)),
}
KEYS = ("clothing_id", "review_text")
K, LG_K = 1_000, 13
# 2.296 / K ** 0.9723, the bound of the sketch's authors; 1.04 / sqrt(2 ** LG_K).
RANK_ERROR = 2.296 / K**0.9723
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)


def build_sketches(df: DataFrame) -> DataFrame:
    """One row per cell of a clean table: the reviews, ``q_<measure>``, ``n_<measure>`` and ``d_<key>``."""
    totals = [F.count(F.lit(1)).alias("reviews")]
    for name, value in MEASURES.items():
        if name in df.columns:
            x = value(name).cast("double")
            totals += [F.kll_sketch_agg_double(x, F.lit(K)).alias(f"q_{name}"), F.count(x).alias(f"n_{name}")]
    totals += [F.hll_sketch_agg(F.col(k).cast("string"), F.lit(LG_K)).alias(f"d_{k}") for k in KEYS if k in df.columns]
    return df.groupBy(*[F.col(identifier(c)) for c in CELL if c in df.columns]).agg(*totals)


def estimated_quantiles(cells: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75), by: str | None = None) -> DataFrame:
    """Rows (segment, measure, n, q1, q2, ...) for the cells given; NULL quantiles where there is no value."""
    keys = [F.col(identifier(by)).alias("segment")] if by else [F.lit(None).cast("string").alias("segment")]
    measures = [m for m in MEASURES if f"q_{m}" in cells.columns]
    # Cells without a value have nothing to add.
    merged = cells.groupBy(*keys).agg(
        *[F.kll_merge_agg_double(F.when(F.col(f"n_{m}") > 0, F.col(f"q_{m}")), F.lit(K)).alias(f"q_{m}") for m in measures],
        *[F.sum(f"n_{m}").alias(f"n_{m}") for m in measures],
    )

    def row(m: str):
        quantile = lambda s: F.when(F.col(f"n_{m}") > 0, F.kll_sketch_get_quantile_double(f"q_{m}", F.lit(s)))
        return F.struct(F.lit(m).alias("measure"), F.col(f"n_{m}").alias("n"), *[quantile(s).alias(f"q{i}") for i, s in enumerate(shares, 1)])

    return merged.select("segment", F.inline(F.array(*map(row, measures))))


def estimated_distinct(cells: DataFrame, key: str = "clothing_id", by: str | None = None) -> DataFrame:
    """Rows (segment, distinct_values): how many values a key column has in the cells given."""
    keys = [F.col(identifier(by)).alias("segment")] if by else [F.lit(None).cast("string").alias("segment")]
    return cells.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(f"d_{key}")).alias("distinct_values"))
