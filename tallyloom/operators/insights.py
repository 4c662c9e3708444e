"""Findings as rows of facts, each with a sentence in plain words.

A finding picks the segment with the highest or lowest measure. All picks of a table come out
of one aggregate (``min_by`` on measure, then name), so nothing is sorted or collected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.classify import ATTENTION_GAP
from tallyloom.functions.numeric import quoted, rate
from tallyloom.functions.text import excerpt
from tallyloom.operators.browse import most_helpful_reviews
from tallyloom.operators.distributions import helpful_votes_by_sentiment
from tallyloom.operators.segments import BASELINES, MEASURES, segment_sums, with_measures
from tallyloom.operators.shapes import Text, as_value, exprs, record, unfold


def pick(columns: Iterable[str], order: str, kept: str = "true") -> str:
    """The first row in the given order as a struct; rows that are not kept are passed over."""
    return f"min_by(struct({', '.join(columns)}), CASE WHEN {kept} THEN struct({order}) END)"


def say(template: str, *values: str) -> str:
    return f"format_string({', '.join([quoted(template), *values])})"


def fact(
    position: int,
    insight: str,
    segment: str | None,
    metric: str,
    value: str | None,
    narrative: str,
    tone: str = Text("neutral"),
    baseline: str | None = None,
    reviews: str | None = None,
    only_if: str = "true",
) -> str:
    """One finding as SQL text; NULL, and thereby left out, unless ``only_if`` holds."""
    number = lambda v: f"double({v or 'NULL'})"
    row = record(
        position=position,
        insight=Text(insight),
        segment=f"string({segment or 'NULL'})",
        metric=Text(metric),
        value=number(value),
        baseline=number(baseline),
        delta=f"{number(value)} - {number(baseline)}",
        reviews=f"bigint({reviews or 'NULL'})",
        tone=tone,
        narrative=narrative,
    )
    return f"CASE WHEN {only_if} THEN {row} END"


def nothing_to_report(what: str) -> str:
    advice = f"No {what} has enough reviews under the current filters; choose fewer or a smaller minimum."
    return fact(1, "Too few reviews", None, "reviews", None, quoted(advice), only_if="found = 0")


def _segments(df: DataFrame, by: str, min_reviews: int) -> DataFrame:
    """Segment table; ``kept`` tells the segments with enough reviews to be picked."""
    table = with_measures(segment_sums(df, by), by)
    return table.selectExpr("*", f"reviews >= {min_reviews} AS kept", f"{BASELINES['negative_rate']} AS base")


def _pick_all(table: DataFrame, by: str, orders: dict[str, str], *more: str) -> DataFrame:
    picks = [f"{pick([by, *MEASURES], order, 'kept')} AS {name}" for name, order in orders.items()]
    return table.agg(
        *exprs("count_if(kept) AS found", "any_value(whole) AS whole", "any_value(base) AS base", *picks, *more)
    )


def executive_insights(df: DataFrame, min_reviews: int = 50) -> DataFrame:
    """Departments: largest, best rated, most negative, most recommended; text coverage."""
    by, some = "department_name", "found > 0"
    row = _pick_all(
        _segments(df, by, min_reviews),
        by,
        {
            "volume": f"-reviews, {by}",
            "rated": f"-avg_rating, {by}",
            "worst": f"-negative_rate, {by}",
            "advocate": f"-recommendation_rate, {by}",
        },
    )
    advocacy = BASELINES["recommendation_rate"]
    coverage = rate("whole.with_text", "whole.reviews")
    return unfold(
        row,
        [
            fact(1, "Largest department", f"volume.{by}", "reviews", "volume.reviews",
                 say("%s has the most reviews: %,d, or %.1f%% of all in scope.",
                     f"volume.{by}", "volume.reviews", "volume.share"),
                 reviews="volume.reviews", only_if=some),
            fact(2, "Best rated department", f"rated.{by}", "avg_rating", "rated.avg_rating",
                 say("%s has the highest average rating, %.2f over %,d reviews.",
                     f"rated.{by}", "rated.avg_rating", "rated.reviews"),
                 tone=Text("positive"), baseline=BASELINES["avg_rating"], reviews="rated.reviews", only_if=some),
            fact(3, "Most negative department", f"worst.{by}", "negative_rate", "worst.negative_rate",
                 say("%s has the highest negative rate, %.1f%%, which is %+.1f points from the overall %.1f%%.",
                     f"worst.{by}", "worst.negative_rate", "worst.negative_rate - base", "base"),
                 tone=Text("negative"), baseline="base", reviews="worst.reviews", only_if=some),
            fact(4, "Most recommended department", f"advocate.{by}", "recommendation_rate",
                 "advocate.recommendation_rate",
                 say("%s is recommended most, by %.1f%% of its reviewers against %.1f%% overall.",
                     f"advocate.{by}", "advocate.recommendation_rate", advocacy),
                 tone=Text("positive"), baseline=advocacy, reviews="advocate.reviews", only_if=some),
            fact(5, "Text coverage", None, "text_coverage_rate", coverage,
                 say("%.1f%% of %,d reviews come with a text; %,d only have a rating.",
                     coverage, "whole.reviews", "whole.reviews - whole.with_text"),
                 reviews="whole.with_text", only_if=some),
            nothing_to_report("department"),
        ],
    ).orderBy("position")


def product_insights(df: DataFrame, min_reviews: int = 50) -> DataFrame:
    """Classes: largest, worst rated, most negative, most recommended; those far off baseline."""
    by, some = "class_name", "found > 0"
    table = _segments(df, by, min_reviews).selectExpr(
        "*", f"kept AND negative_rate - base >= {ATTENTION_GAP} AS flagged"
    )
    # Five rows at most are gathered: orderBy with limit comes first.
    worst_five = (
        table.filter("flagged")
        .orderBy(F.desc("negative_rate"), by)
        .limit(5)
        .agg(*exprs(f"sort_array(collect_list(struct(-negative_rate AS place, {by} AS name))) AS five"))
    )
    row = _pick_all(
        table,
        by,
        {
            "volume": f"-reviews, {by}",
            "lowest": f"avg_rating, {by}",
            "worst": f"-negative_rate, {by}",
            "advocate": f"-recommendation_rate, {by}",
        },
        "count_if(flagged) AS flags",
        "coalesce(sum(CASE WHEN flagged THEN negative_reviews END), 0L) AS flagged_negatives",
    ).withColumn("five", worst_five.scalar())
    listed = "array_join(transform(five, x -> format_string('%s (%.1f%%)', x.name, -x.place)), ', ')"
    return unfold(
        row,
        [
            fact(1, "Largest class", f"volume.{by}", "reviews", "volume.reviews",
                 say("%s has the most reviews of all classes: %,d (%.1f%%).",
                     f"volume.{by}", "volume.reviews", "volume.share"),
                 reviews="volume.reviews", only_if=some),
            fact(2, "Lowest rated class", f"lowest.{by}", "avg_rating", "lowest.avg_rating",
                 say("%s has the lowest average rating, %.2f over %,d reviews.",
                     f"lowest.{by}", "lowest.avg_rating", "lowest.reviews"),
                 tone=Text("negative"), reviews="lowest.reviews", only_if=some),
            fact(3, "Most negative class", f"worst.{by}", "negative_rate", "worst.negative_rate",
                 say("%s has the highest negative rate, %.1f%% (%,d of %,d reviews).",
                     f"worst.{by}", "worst.negative_rate", "worst.negative_reviews", "worst.reviews"),
                 tone=Text("negative"), baseline="base", reviews="worst.reviews", only_if=some),
            fact(4, "Most recommended class", f"advocate.{by}", "recommendation_rate",
                 "advocate.recommendation_rate",
                 say("%s is recommended most, by %.1f%% of its reviewers.",
                     f"advocate.{by}", "advocate.recommendation_rate"),
                 tone=Text("positive"), reviews="advocate.reviews", only_if=some),
            fact(5, "Classes that need attention", listed, "flagged_classes", "flags",
                 say("%,d classes lie at least 5 points above the overall negative rate of %.1f%%, "
                     "with %,d negative reviews; worst first: %s.",
                     "flags", "base", "flagged_negatives", listed),
                 tone=Text("negative"), reviews="flagged_negatives", only_if="flags > 0"),
            nothing_to_report("product class"),
        ],
    ).orderBy("position")


def customer_insights(df: DataFrame, min_reviews: int = 50) -> DataFrame:
    """Age bands by advocacy and rating, votes by sentiment, the most helpful negative review."""
    by, some = "age_band", "found > 0"
    votes = helpful_votes_by_sentiment(df)
    leaders = votes.agg(
        *exprs(
            "sum(total_helpful_votes) AS total",
            f"{pick(votes.columns, '-total_helpful_votes, sentiment')} AS most",
            f"{pick(votes.columns, '-avg_helpful_votes, sentiment')} AS each",
        )
    )
    critic = most_helpful_reviews(df, 1, negative_only=True).select(
        "helpful_votes", "department", F.col("class").alias("product_class"), "age",
        excerpt("review_text").alias("text"),
    )
    row = _pick_all(
        _segments(df, by, min_reviews),
        by,
        {
            "advocate": f"-recommendation_rate, {by}",
            "laggard": f"recommendation_rate, {by}",
            "lowest": f"avg_rating, {by}",
        },
    ).withColumns({"votes": as_value(leaders), "critic": as_value(critic)})
    return unfold(
        row,
        [
            fact(1, "Age band that recommends most", f"advocate.{by}", "recommendation_rate",
                 "advocate.recommendation_rate",
                 say("%s recommend most (%.1f%%), %s least (%.1f%%): %.1f points apart.",
                     f"advocate.{by}", "advocate.recommendation_rate",
                     f"laggard.{by}", "laggard.recommendation_rate",
                     "advocate.recommendation_rate - laggard.recommendation_rate"),
                 tone=Text("positive"), baseline="laggard.recommendation_rate",
                 reviews="advocate.reviews", only_if=some),
            fact(2, "Age band with the lowest rating", f"lowest.{by}", "avg_rating", "lowest.avg_rating",
                 say("%s rate lowest, %.2f over %,d reviews; %.1f%% of them are negative (%.1f%% overall).",
                     f"lowest.{by}", "lowest.avg_rating", "lowest.reviews", "lowest.negative_rate", "base"),
                 tone=Text("negative"), reviews="lowest.reviews", only_if=some),
            fact(3, "Sentiment with most helpful votes", "votes.most.sentiment", "total_helpful_votes",
                 "votes.most.total_helpful_votes",
                 say("%s reviews get most votes in all (%,d, %.1f%%); per review it is %s ones (%.2f).",
                     "votes.most.sentiment", "votes.most.total_helpful_votes", "votes.most.share_of_votes",
                     "votes.each.sentiment", "votes.each.avg_helpful_votes"),
                 reviews="votes.most.reviews", only_if=f"{some} AND votes.total > 0"),
            fact(4, "Most helpful negative review", "critic.product_class", "helpful_votes",
                 "critic.helpful_votes",
                 say("%,d readers found this review helpful (%s / %s, age %s): %s",
                     "critic.helpful_votes", "critic.department", "critic.product_class",
                     "coalesce(string(bigint(critic.age)), 'unknown')", "critic.text"),
                 tone=Text("negative"), reviews="1", only_if=f"{some} AND critic IS NOT NULL"),
            nothing_to_report("age band"),
        ],
    ).orderBy("position")


def scenario_insights(result: DataFrame, departments: DataFrame) -> DataFrame:
    """Rate changes of a one-row simulation result, and two departments to look at."""
    # Only what the sentences need: without the simulated rating, no review has to be ranked.
    columns = (
        "department", "reviews", "successful_negative_cases", "sim_negative_rate",
        "remaining_negative_reviews", "priority",
    )
    picks = departments.agg(
        *exprs(
            "count(1) AS found",
            f"{pick(columns, '-successful_negative_cases, department')} AS volume",
            f"{pick(columns, '-sim_negative_rate, -remaining_negative_reviews, department')} AS risk",
        )
    )
    some, both = "n > 0", "n > 0 AND picks.found > 0"

    def change(position: int, kind: str, sign: str, text: str, *values: str) -> str:
        before, after = f"baseline_{kind}_rate", f"sim_{kind}_rate"
        return fact(
            position, f"Change of the {kind} rate", None, after, after,
            say(f"The {kind} rate would go from %.1f%% to %.1f%%; {text}", before, after, *values),
            tone=f"CASE WHEN {sign}({after} - {before}) > 0 THEN 'positive' ELSE 'neutral' END",
            baseline=before, reviews="n", only_if=some,
        )

    return unfold(
        result.withColumn("picks", as_value(picks)),
        [
            change(1, "negative", "-", "%,d of %,d negative reviews improve.", "successful_neg", "neg"),
            change(2, "positive", "+", "%,d negative and %,d neutral reviews become positive.",
                   "neg_to_pos", "neu_to_pos"),
            change(3, "recommendation", "+", "%,d of %,d reviewers who did not recommend would.",
                   "advocacy_conversions", "not_recommended"),
            fact(4, "Largest improvable volume", "picks.volume.department", "successful_negative_cases",
                 "picks.volume.successful_negative_cases",
                 say("%s has the most negative reviews that improve: %,d of %,d reviews.",
                     "picks.volume.department", "picks.volume.successful_negative_cases",
                     "picks.volume.reviews"),
                 reviews="picks.volume.reviews", only_if=both),
            fact(5, "Highest remaining risk", "picks.risk.department", "sim_negative_rate",
                 "picks.risk.sim_negative_rate",
                 say("%s keeps the highest negative rate, %.1f%% (%,d reviews, priority %s).",
                     "picks.risk.department", "picks.risk.sim_negative_rate",
                     "picks.risk.remaining_negative_reviews", "picks.risk.priority"),
                 tone=Text("negative"), baseline="sim_negative_rate",
                 reviews="picks.risk.remaining_negative_reviews", only_if=both),
            fact(1, "No reviews in scope", None, "reviews", "n",
                 quoted("The scope of the scenario is empty; choose wider filters or more categories."),
                 only_if="n = 0"),
        ],
    ).orderBy("position")
