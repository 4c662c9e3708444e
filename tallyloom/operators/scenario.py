"""What-if scenarios: move a part of the negative and neutral reviews and recompute the rates.

Counts and rates come out of one row of sums per segment. The simulated rating needs the first K
reviews of a class in ``row_id`` order. A global row number would pull all reviews of a segment
into one task, so reviews are summed up per range of ``row_id`` instead: running counts over this
*ledger* tell which ranges lie wholly on one side of the K-th review, and only reviews of the
ranges that K cuts through are ranked, each range by itself. The ranges end at quantiles of the
ids, so each holds a like share of the reviews, however the ids are spread.

A stored layer keeps a ledger (``tallyloom.operators.ledger``); with it, sums come from there, and
nothing but the cut ranges is read from the reviews. Without one, sums and quantiles are worked out
for the query. The rating's part is joined by unique keys, so a query that does not read the
rating does not work it out. Scenarios are told apart by their place in the list; names are labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import classify
from tallyloom.functions.numeric import double, identifier, mean, rate, share_of
from tallyloom.names import PRIORITIES, ROW_ID
from tallyloom.operators.ledger import Ledger, bucket
from tallyloom.operators.segments import SUMS, segment_sums
from tallyloom.operators.shapes import Text, as_value, exprs, position, record, unfold

# A range of ids is found in three steps, one of WAYS parts each: WAYS ** 3 ranges in all.
WAYS = 8
# The name that the segment column has while a simulation runs.
SEGMENT = "_segment"


@dataclass(frozen=True)
class Assumptions:
    """Intervention rates in percent; ``name`` labels a scenario of a sweep."""

    negative_reached: float = 60.0
    intervention_success: float = 50.0
    success_to_positive: float = 70.0
    neutral_to_positive: float = 20.0
    advocacy_conversion: float = 25.0
    name: str = "default"

    def as_record(self, place: int) -> str:
        return record(
            place=place,
            scenario=Text(self.name),
            reached=double(self.negative_reached / 100.0),
            success=double(self.intervention_success / 100.0),
            to_positive=double(self.success_to_positive / 100.0),
            neutral=double(self.neutral_to_positive / 100.0),
            advocacy=double(self.advocacy_conversion / 100.0),
        )


DEFAULT = Assumptions()

COUNTS = (
    "n", "neg", "neu", "pos", "recommended", "not_recommended", "reached_neg",
    "successful_neg", "neg_to_pos", "neg_to_neu", "neu_to_pos", "advocacy_conversions",
)
RESULT = {
    **{c: c for c in COUNTS},
    "avg_rating": "avg_rating",
    "rating_sum": "rating_sum",
    "sim_neg": "neg - successful_neg",
    "sim_neu": "neu + neg_to_neu - neu_to_pos",
    "sim_pos": "pos + neg_to_pos + neu_to_pos",
    "sim_recommended": "recommended + advocacy_conversions",
    "sim_not_recommended": "not_recommended - advocacy_conversions",
    "sim_rating_sum": "rating_sum + change",
    "sim_avg_rating": mean("rating_sum + change", "n"),
    "baseline_positive_rate": rate("pos", "n"),
    "baseline_neutral_rate": rate("neu", "n"),
    "baseline_negative_rate": rate("neg", "n"),
    "baseline_recommendation_rate": rate("recommended", "n"),
    "sim_positive_rate": rate("pos + neg_to_pos + neu_to_pos", "n"),
    "sim_neutral_rate": rate("neu + neg_to_neu - neu_to_pos", "n"),
    "sim_negative_rate": rate("neg - successful_neg", "n"),
    "sim_recommendation_rate": rate("recommended + advocacy_conversions", "n"),
    "successfully_improved_reviews": "successful_neg + neu_to_pos",
}


def _listed(assumptions: Assumptions | Sequence[Assumptions]) -> list[Assumptions]:
    return [assumptions] if isinstance(assumptions, Assumptions) else list(assumptions)


def _cut_points(df: DataFrame, ways: int):
    """Quantiles of the ids of negative and neutral reviews, as one value with three levels.

    ``top`` divides the ids into ``ways`` parts, ``middle`` each of these, ``low`` each of those.
    """
    parts = ways**3
    shares = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    points = df.filter("sentiment IN ('Negative', 'Neutral')").agg(
        F.expr(f"percentile_approx({ROW_ID}, array({shares}), {100 * parts}) AS p")
    )

    def level(step: int) -> str:
        inner = f"transform(sequence(1, {ways - 1}), j -> p[i * {step * ways} + j * {step} - 1])"
        return f"transform(sequence(0, {parts // (step * ways) - 1}), i -> {inner})"

    return as_value(points.selectExpr(f"{level(ways * ways)} AS top", f"{level(ways)} AS middle", f"{level(1)} AS low"))


def _bucketed(df: DataFrame, cuts, ways: int) -> DataFrame:
    """Add the range of ids of negative and neutral reviews; all others share the bucket NULL."""
    columns = df.columns
    moves = F.expr("sentiment IN ('Negative', 'Neutral')")
    part = F.lit(0)
    for level in ("top", "middle", "low"):
        below = F.size(F.filter(F.get(F.col(f"_cuts.{level}"), part), lambda c: c <= F.col(ROW_ID)))
        part = part * ways + below
    return df.withColumn("_cuts", cuts).select(*[F.col(identifier(c)) for c in columns], F.when(moves, part).alias("bucket"))


def _same(keys: list[str]) -> Column:
    """Equality of columns with those of the same name and an underscore; NULL equals NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"{key}_"))
    return condition


def _other(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({key: f"{key}_" for key in keys})


# Baseline and movements of a segment from its sums ``t`` and assumptions ``a``. Reviews without a
# sentiment count as positive, those without a known flag as recommended, provided any is known.
FIGURES = (
    "t.reviews AS n",
    "t.negative AS neg",
    "t.neutral AS neu",
    "n - neg - neu AS pos",
    "CASE WHEN t.recommended + t.not_recommended BETWEEN 1 AND n - 1"
    " THEN n - t.not_recommended ELSE t.recommended END AS recommended",
    "t.not_recommended AS not_recommended",
    f"{share_of('neg', 'a.reached')} AS reached_neg",
    f"{share_of('reached_neg', 'a.success')} AS successful_neg",
    f"{share_of('successful_neg', 'a.to_positive')} AS neg_to_pos",
    "successful_neg - neg_to_pos AS neg_to_neu",
    f"{share_of('neu', 'a.neutral')} AS neu_to_pos",
    f"{share_of('not_recommended', 'a.advocacy')} AS advocacy_conversions",
    f"{mean('t.rating_sum', 't.rated')} AS avg_rating",
    "coalesce(t.rating_sum, 0D) AS rating_sum",
)


def _scenarios(assumptions: Sequence[Assumptions]) -> str:
    records = [a.as_record(place) for place, a in enumerate(assumptions)]
    return f"explode(array({', '.join(records)})) AS a"


def figures(sums: DataFrame, by: list[str], assumptions: Sequence[Assumptions]) -> DataFrame:
    """Baseline and movements per segment and scenario, from one row of sums per segment."""
    total = ", ".join(f"'{c}', coalesce({c}, 0)" if c != "rating_sum" else f"'{c}', {c}" for c in SUMS)
    return (
        sums.selectExpr(*by, f"named_struct({total}) AS t")
        .selectExpr("*", _scenarios(assumptions))
        .selectExpr(*by, "a", "a.place AS place", "a.scenario AS scenario", *FIGURES)
    )


def movements(ledger: DataFrame, by: list[str], assumptions: Sequence[Assumptions]) -> DataFrame:
    """One row per bucket and scenario: the bucket's place among the reviews of its sentiment, and
    what it adds to the sum of ratings.

    ``change`` is NULL for a bucket that a limit cuts through.
    """
    earlier = (
        f"PARTITION BY {', '.join([*by, 'sentiment'])} ORDER BY bucket "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    )
    if by:
        totals = ", ".join(f"'{c}', sum({c}) OVER (PARTITION BY {', '.join(by)})" for c in SUMS)
        ledger = ledger.selectExpr("*", f"named_struct({totals}) AS t")
    else:
        ledger = ledger.withColumn("t", as_value(ledger.agg(*exprs(*[f"sum({c}) AS {c}" for c in SUMS]))))
    return (
        ledger.selectExpr(
            *by, "sentiment", "bucket", "reviews AS size", "rating_sum AS stars",
            f"coalesce(sum(reviews) OVER ({earlier}), 0L) AS first",
            "t",
        )
        .selectExpr("*", _scenarios(assumptions))
        .selectExpr(
            *by, "a", "a.place AS place", "sentiment", "bucket", "size", "stars", "first",
            "first + size AS end",
            *FIGURES[:-2],
            # Reviews ranked below ``to_four`` get 4 stars, those below ``to_three`` 3 stars.
            "CASE sentiment WHEN 'Negative' THEN neg_to_pos WHEN 'Neutral' THEN neu_to_pos ELSE 0L END AS to_four",
            "CASE sentiment WHEN 'Negative' THEN successful_neg ELSE to_four END AS to_three",
            "CASE WHEN first >= to_three THEN 0D WHEN end <= to_four THEN size * 4D - stars"
            " WHEN first >= to_four AND end <= to_three THEN size * 3D - stars END AS change",
        )
    )


def _rating_change(ranged: DataFrame, ledger: DataFrame, by: list[str], assumptions: Sequence[Assumptions]) -> DataFrame:
    """What the scenarios add to the sum of ratings: one row per segment (``key_``) and ``place_``."""
    moved = movements(ledger, by, assumptions)
    keys = [*by, "sentiment", "bucket"]
    # At most three buckets are cut per segment and scenario; Spark decides how to join them.
    cut = moved.filter("change IS NULL").select(*keys, "place", "first", "to_four", "to_three")
    in_bucket = f"PARTITION BY place, {', '.join(keys)} ORDER BY {ROW_ID}"
    ranked = (
        ranged.filter("bucket IS NOT NULL")
        .select(*keys, ROW_ID, "rating")
        .join(_other(cut, keys), _same(keys))
        .selectExpr("*", f"first + row_number() OVER ({in_bucket}) - 1 AS rank")
    )
    within = ranked.filter("rank < to_three").selectExpr(*by, "place", "CASE WHEN rank < to_four THEN 4D ELSE 3D END - rating AS change")
    # A struct is never NULL, so NULL is a segment like any other.
    return (
        moved.filter("change IS NOT NULL").select(*by, "place", "change").union(within)
        .groupBy(F.struct(F.lit(0).alias("_"), *by).alias("key_"), F.col("place").alias("place_"))
        .agg(F.sum("change").alias("change"))
    )


def _simulate(
    df: DataFrame, by: str | None, assumptions: Sequence[Assumptions], ways: int, ledger: Ledger | None
) -> DataFrame:
    """Counts, movements and the change of the sum of ratings per segment and scenario."""
    segments = [F.col(identifier(by)).alias(SEGMENT)] if by else []
    measured = ("rating", "recommended_ind", "positive_feedback_count", "has_review_text", "sentiment", "recommendation_label", "valid_recommendation")
    reviews = df.select(*segments, *[c for c in df.columns if c in (ROW_ID, *measured)])
    keys = [SEGMENT] if by else []
    kept = ledger.of(by) if ledger else None
    ranged = reviews.withColumn("bucket", bucket(ledger.cuts, ledger.ways)) if ledger else _bucketed(reviews, _cut_points(df, ways), ways)
    if kept is not None:
        table = kept.withColumnRenamed("label", SEGMENT) if by else kept.drop("label")
        sums = table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    else:
        table = segment_sums(ranged, *keys, "sentiment", "bucket")
        sums = segment_sums(reviews, *keys)
    base = figures(sums, keys, assumptions)
    change = _rating_change(ranged, table, keys, assumptions)
    own = F.struct(F.lit(0).alias("_"), *keys)
    return base.join(change, (own == F.col("key_")) & (F.col("place") == F.col("place_")), "left").select(
        *base.columns, F.coalesce("change", F.lit(0.0)).alias("change")
    )


def run_simulation(
    df: DataFrame,
    assumptions: Assumptions | Sequence[Assumptions] = DEFAULT,
    by: str | None = None,
    ways: int = WAYS,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Baseline, movements and simulated figures: one row per scenario (and value of ``by``).

    Without ``by`` an empty table gives a row of zeros. ``ledger`` is one of the same reviews.
    """
    several = _listed(assumptions)
    result = [f"{how} AS {name}" for name, how in RESULT.items()]
    if by:
        return _simulate(df, by, several, ways, ledger).selectExpr("scenario", f"{SEGMENT} AS {identifier(by)}", *result)
    return _simulate(df, None, several, ways, ledger).selectExpr("scenario", *result)


def finite_kpis(result: DataFrame) -> DataFrame:
    """Whether every figure of a simulation result is a finite number."""
    figures = ["avg_rating", "sim_avg_rating"] + [
        f"{prefix}_{name}_rate"
        for prefix in ("baseline", "sim")
        for name in ("positive", "neutral", "negative", "recommendation")
    ]
    return result.selectExpr("*", f"{classify.all_finite(*figures)} AS finite")


def department_simulation(
    df: DataFrame,
    assumptions: Assumptions | Sequence[Assumptions] = DEFAULT,
    min_reviews: int = 0,
    by: str = "department_name",
    ways: int = WAYS,
    ledger: Ledger | None = None,
) -> DataFrame:
    """One simulation per department, most urgent first.

    Each department is rounded by itself, so rows need not add up to the overall scenario. The
    overall rate and the shares include departments below ``min_reviews``.
    """
    improved = share_of(share_of("all_neg", "a.reached"), "a.success")
    overall = rate(f"all_neg - {improved}", "all_n")
    share = rate("n", "all_n")
    table = (
        _simulate(df, by, _listed(assumptions), ways, ledger)
        .selectExpr(
            "*",
            "sum(n) OVER (PARTITION BY place) AS all_n",
            "sum(neg) OVER (PARTITION BY place) AS all_neg",
        )
        .filter(f"n >= {min_reviews}")
        .selectExpr(
            "place",
            "scenario",
            f"{SEGMENT} AS department",
            "n AS reviews",
            "avg_rating AS baseline_avg_rating",
            *[
                f"{RESULT[c]} AS {c}"
                for c in (
                    "sim_avg_rating", "baseline_positive_rate", "sim_positive_rate",
                    "baseline_negative_rate", "sim_negative_rate",
                    "baseline_recommendation_rate", "sim_recommendation_rate",
                )
            ],
            "successful_neg AS successful_negative_cases",
            f"{RESULT['sim_neg']} AS remaining_negative_reviews",
            f"{classify.priority(RESULT['sim_negative_rate'], overall, share)} AS priority",
            f"{RESULT['successfully_improved_reviews']} AS improved_cases",
            f"{share} AS share",
        )
    )
    return table.orderBy(
        "scenario",
        "place",
        position("priority", PRIORITIES),
        F.desc("remaining_negative_reviews"),
        F.desc("reviews"),
        "department",
    ).drop("place")


def department_impact(
    df: DataFrame,
    assumptions: Assumptions = DEFAULT,
    min_reviews: int = 50,
    ways: int = WAYS,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Departments by the number of negative reviews the scenario removes."""
    table = department_simulation(df, assumptions, min_reviews, ways=ways, ledger=ledger)
    return table.selectExpr("*", "successful_negative_cases AS negative_reduction").orderBy(
        F.desc("negative_reduction"), "department"
    )


def sentiment_comparison(result: DataFrame) -> DataFrame:
    """Six rows: baseline and simulated count and share per sentiment; none for an empty scope."""
    rows = [
        record(
            sentiment=Text(label),
            series=Text(series),
            reviews=f"{prefix}{short}",
            share=rate(f"{prefix}{short}", "n"),
        )
        for label, short in (("Negative", "neg"), ("Neutral", "neu"), ("Positive", "pos"))
        for series, prefix in (("Dataset Baseline", ""), ("Simulated Scenario", "sim_"))
    ]
    return unfold(result.filter("n > 0"), rows)


def kpi_change(result: DataFrame) -> DataFrame:
    """Baseline, simulated value, change and its direction for five KPIs.

    The first four are the comparison chart's; the neutral rate completes the KPI cards.
    """
    kpis = (
        ("Average Rating", "rating", "avg_rating", "sim_avg_rating", True, "1e-12D"),
        ("Positive Rate", "percent", "baseline_positive_rate", "sim_positive_rate", True, "1e-12D"),
        ("Negative Rate", "percent", "baseline_negative_rate", "sim_negative_rate", False, "1e-12D"),
        ("Recommendation Rate", "percent", "baseline_recommendation_rate", "sim_recommendation_rate", True, "1e-12D"),
        ("Neutral Rate", "percent", "baseline_neutral_rate", "sim_neutral_rate", False, "1e-9D"),
    )
    return unfold(
        result,
        [
            record(
                metric=Text(label),
                kind=Text(kind),
                baseline=before,
                simulated=after,
                change=f"{after} - {before}",
                direction=classify.direction(f"({after} - {before})", up, tolerance),
            )
            for label, kind, before, after, up, tolerance in kpis
        ],
    )


def kpi_improvement(result: DataFrame) -> DataFrame:
    """The four metrics of the comparison chart."""
    return kpi_change(result).filter("metric <> 'Neutral Rate'").drop("direction")


def movement_steps(result: DataFrame) -> DataFrame:
    """How many reviews move where."""
    steps = (
        ("Negative cases improved", "successful_neg", "outflow"),
        ("Negative to Neutral", "neg_to_neu", "shift"),
        ("Negative to Positive", "neg_to_pos", "shift"),
        ("Neutral to Positive", "neu_to_pos", "shift"),
    )
    return unfold(
        result,
        [record(step=Text(s), reviews=c, direction=Text(d)) for s, c, d in steps],
    )
