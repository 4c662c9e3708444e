"""The scenario ledger: sums of reviews by segment, sentiment and range of ids.

Running counts over it tell at which id a scenario's limit falls, up to a range, so that no review
outside of that range has to be read one by one. Ranges end at quantiles of the ids, taken once
when the ledger is built; the points are part of the ledger, and any subset of its reviews may be
put into the same ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.numeric import identifier
from tallyloom.names import ROW_ID
from tallyloom.operators.segments import SUMS, segment_sums

# A range of ids is found in three steps, one of ``ways`` parts each: ways ** 3 ranges in all.
MOST_WAYS = 8
# Reviews that a range should have at least, so that a ledger stays small beside its reviews.
RANGE = 2_000
# Columns that a stored ledger is kept for, one by one, besides the whole.
KEPT = ("division_name", "department_name", "class_name")
WHOLE = ""


@dataclass(frozen=True)
class Ledger:
    """dimension (empty for the whole), label, sentiment, bucket and sums; cut points of the ids."""

    table: DataFrame
    cuts: tuple[int, ...]
    ways: int

    def of(self, by: str | None) -> DataFrame | None:
        """The sums by one column or for the whole, with its values as ``label``; None if not kept."""
        if by is not None and by not in KEPT:
            return None
        return self.table.filter(F.col("dimension") == (by or WHOLE)).drop("dimension")

    def scoped(self, column: str, labels: list[str]) -> Ledger:
        """The ledger of the reviews with one of some labels, for the whole and the same column."""
        own = self.table.filter((F.col("dimension") == column) & F.col("label").isin(*labels))
        sums = [F.sum(c).alias(c) for c in SUMS]
        whole = own.groupBy(F.lit(WHOLE).alias("dimension"), F.lit(None).cast("string").alias("label"), "sentiment", "bucket").agg(*sums)
        return Ledger(own.unionByName(whole), self.cuts, self.ways)


def moving(df: DataFrame) -> DataFrame:
    """Reviews that a scenario may re-rate."""
    return df.filter("sentiment IN ('Negative', 'Neutral')")


def cut_points(df: DataFrame, ways: int | None = None) -> tuple[tuple[int, ...], int]:
    """Ids at which ranges end, and the number of parts per step: one pass over the ids of moving reviews."""
    most = MOST_WAYS**3 if ways is None else ways**3
    shares = ", ".join(f"{i / most!r}D" for i in range(1, most))
    found = moving(df).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx({ROW_ID}, array({shares}), {100 * most}) AS p")
    ).first()
    points = list(found["p"] or [0] * (most - 1))
    if ways is None:
        ways = next((w for w in range(MOST_WAYS, 2, -1) if w**3 * RANGE <= found["n"]), 2)
    step = most / ways**3
    return tuple(points[max(0, round(i * step) - 1)] for i in range(1, ways**3)), ways


def bucket(cuts: tuple[int, ...], ways: int) -> Column:
    """The range of a moving review's id, found in three steps; NULL for all other reviews."""
    place = F.lit(0)
    parts = ways**3
    for step in (ways * ways, ways, 1):
        rows = [
            F.array(*(F.lit(cuts[i * step * ways + j * step - 1]) for j in range(1, ways)))
            for i in range(parts // (step * ways))
        ]
        level = F.lit(None) if not rows else F.array(*rows)
        below = F.size(F.filter(F.get(level, place), lambda c: c <= F.col(ROW_ID)))
        place = place * ways + below
    return F.when(F.expr("sentiment IN ('Negative', 'Neutral')"), place)


def build_ledger(df: DataFrame, ways: int | None = None) -> Ledger:
    """The ledger of a clean table, for the whole and each of the kept columns it has."""
    cuts, ways = cut_points(df, ways)
    kept = [c for c in KEPT if c in df.columns]
    measured = ("rating", "recommended_ind", "positive_feedback_count", "has_review_text", "sentiment", "recommendation_label", "valid_recommendation")
    ranged = df.select(*kept, *[c for c in measured if c in df.columns], bucket(cuts, ways).alias("bucket"))
    pairs = [F.struct(F.lit(WHOLE).alias("dimension"), F.lit(None).cast("string").alias("label"))]
    pairs += [F.struct(F.lit(c).alias("dimension"), F.col(identifier(c)).alias("label")) for c in kept]
    # One pass over the reviews: sums by all columns at once are few, and they are summed up again by each.
    sums = segment_sums(ranged, *kept, "sentiment", "bucket")
    each = sums.withColumn("d", F.explode(F.array(*pairs)))
    table = each.groupBy("d.dimension", "d.label", "sentiment", "bucket").agg(*[F.sum(c).alias(c) for c in SUMS])
    return Ledger(table, cuts, ways)
