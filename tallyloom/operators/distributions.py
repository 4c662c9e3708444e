"""Counts and shares per label, helpful votes per sentiment, and numeric summaries.

Label sets are fixed and short, so each distribution is one global aggregate of conditional
counts, unfolded into rows: no shuffle by key, and absent labels come out as zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.classify import share_label
from tallyloom.functions.numeric import mean, rate
from tallyloom.names import RATINGS, RECOMMENDATIONS, SENTIMENTS
from tallyloom.operators.shapes import Text, as_value, exprs, record, unfold


def _label_counts(df: DataFrame, column: str, labels) -> tuple[DataFrame, list[str], str]:
    """Counts per label as columns of one row, their names, and their total."""
    names = [f"n{i}" for i in range(len(labels))]
    literals = [repr(v) if isinstance(v, str) else f"{v}" for v in labels]
    counts = df.agg(*exprs(*[f"count_if({column} = {v}) AS {n}" for n, v in zip(names, literals)]))
    return counts, names, f"({' + '.join(names)})"


def sentiment_distribution(df: DataFrame) -> DataFrame:
    counts, names, total = _label_counts(df, "sentiment", SENTIMENTS)
    return unfold(
        counts,
        [
            record(sentiment=Text(s), reviews=n, share=rate(n, total))
            for s, n in zip(SENTIMENTS, names)
        ],
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    """Whole stars only; 4.5 is in no row."""
    counts, names, total = _label_counts(df, "rating", RATINGS)
    return unfold(
        counts,
        [
            record(
                rating=r,
                rating_label=Text(f"{r} star" if r == 1 else f"{r} stars"),
                reviews=n,
                share=rate(n, total),
            )
            for r, n in zip(RATINGS, names)
        ],
    )


def recommendation_distribution(df: DataFrame) -> DataFrame:
    counts, names, total = _label_counts(df, "recommendation_label", RECOMMENDATIONS)
    return unfold(
        counts,
        [
            record(recommendation=Text(r), reviews=n, share=rate(n, total))
            for r, n in zip(RECOMMENDATIONS, names)
        ],
    )


def _recommendation_cells(df: DataFrame) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """The six counts as columns of one row, and their names by sentiment and recommendation."""
    cells = {
        s: {r: f"n{i}{j}" for j, r in enumerate(RECOMMENDATIONS)} for i, s in enumerate(SENTIMENTS)
    }
    counts = df.agg(
        *exprs(
            *[
                f"count_if(sentiment = '{s}' AND recommendation_label = '{r}') AS {name}"
                for s, names in cells.items()
                for r, name in names.items()
            ]
        )
    )
    return counts, cells


def recommendation_by_sentiment(df: DataFrame) -> DataFrame:
    """Six cells with the share of each recommendation within its sentiment."""
    counts, cells = _recommendation_cells(df)
    return unfold(
        counts,
        [
            record(
                sentiment=Text(s),
                recommendation=Text(r),
                reviews=n,
                share=rate(n, " + ".join(names.values())),
            )
            for s, names in cells.items()
            for r, n in names.items()
        ],
    )


def recommendation_stack(df: DataFrame) -> DataFrame:
    """One row per sentiment with both shares side by side and their labels."""
    counts, cells = _recommendation_cells(df)
    records = []
    for s, names in cells.items():
        no, yes = names.values()
        shares = {"not_recommended": rate(no, f"{no} + {yes}"), "recommended": rate(yes, f"{no} + {yes}")}
        records.append(
            record(
                sentiment=Text(s),
                not_recommended_reviews=no,
                recommended_reviews=yes,
                **{f"{k}_share": v for k, v in shares.items()},
                **{f"{k}_label": share_label(v) for k, v in shares.items()},
            )
        )
    return unfold(counts, records)


def age_distribution(df: DataFrame) -> DataFrame:
    return df.select("age").filter("age IS NOT NULL AND NOT isnan(age)")


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values with their counts ``n``: the input of exact weighted percentiles.

    Equal values collapse before the shuffle, so what is left is as large as the domain of
    the measure (stars, ages, votes, words), not as the table.
    """
    return df.groupBy(*exprs(*columns)).agg(F.count(F.lit(1)).alias("n"))


def helpful_votes_by_sentiment(df: DataFrame) -> DataFrame:
    freq = frequencies(df, "sentiment", "coalesce(positive_feedback_count, 0D) AS v")
    measures, records = [], []
    grand = " + ".join(f"coalesce({s}_total, 0D)" for s in SENTIMENTS)
    for s in SENTIMENTS:
        weight = f"CASE WHEN sentiment = '{s}' THEN n ELSE 0L END"
        measures += [
            f"coalesce(sum({weight}), 0L) AS {s}_reviews",
            f"sum(({weight}) * v) AS {s}_total",
            f"coalesce(sum(CASE WHEN v >= 1 THEN {weight} END), 0L) AS {s}_voted",
            f"percentile(v, 0.5D, {weight}) AS {s}_median",
        ]
        records.append(
            record(
                sentiment=Text(s),
                reviews=f"{s}_reviews",
                total_helpful_votes=f"bigint(coalesce({s}_total, 0))",
                avg_helpful_votes=mean(f"{s}_total", f"{s}_reviews"),
                median_helpful_votes=f"coalesce({s}_median, 0D)",
                reviews_with_votes=f"{s}_voted",
                share_of_votes=rate(f"{s}_total", grand),
            )
        )
    return unfold(freq.agg(*exprs(*measures)), records)


NUMERIC_MEASURES = ("age", "rating", "positive_feedback_count", "review_length_words")


# Accuracy of approximate percentiles: a rank is off by at most one part in so many.
ACCURACY = 10_000


def numeric_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Count, mean, quartiles, deviation and range of the numeric columns that have values.

    ``exact=False`` takes the quartiles from a sketch of bounded size instead of all distinct
    values, for measures with very many of them; ranks are off by 1/ACCURACY at most.
    """
    pairs = ", ".join(
        f"named_struct('measure', '{c}', 'v', double({c}))" for c in NUMERIC_MEASURES if c in df.columns
    )
    values = df.selectExpr(f"inline(array({pairs}))").filter("v IS NOT NULL AND NOT isnan(v)")
    if not exact:
        return (
            values.groupBy("measure")
            .agg(
                *exprs(
                    "count(1) AS count", "avg(v) AS mean", "coalesce(stddev_samp(v), 0D) AS std_dev",
                    f"percentile_approx(v, array(0.25D, 0.5D, 0.75D), {ACCURACY}) AS q", "min(v) AS min", "max(v) AS max",
                )
            )
            .selectExpr(
                "measure", "count", "mean", "q[1] AS median", "std_dev", "min", "q[0] AS p25", "q[2] AS p75", "max"
            )
            .orderBy("measure")
        )
    freq = frequencies(values, "measure", "v")
    centre = "sum(v * n) OVER (PARTITION BY measure) / sum(n) OVER (PARTITION BY measure)"
    return (
        freq.selectExpr("*", f"{centre} AS centre")
        .groupBy("measure")
        .agg(
            *exprs(
                "sum(n) AS count",
                "sum(v * n) / sum(n) AS mean",
                "percentile(v, array(0.25D, 0.5D, 0.75D), n) AS q",
                "sum(n * (v - centre) * (v - centre)) AS squares",
                "min(v) AS min",
                "max(v) AS max",
            )
        )
        .selectExpr(
            "measure", "count", "mean", "q[1] AS median",
            "coalesce(sqrt(try_divide(squares, count - 1)), 0D) AS std_dev",
            "min", "q[0] AS p25", "q[2] AS p75", "max",
        )
        .orderBy("measure")
    )


def age_histogram(df: DataFrame, width: int = 5, exact: bool = True) -> DataFrame:
    """Reviews per age bin, counted from the smallest age; bins without reviews are absent.

    ``exact=False`` estimates the median to a rank off by 1/ACCURACY at most.
    """
    freq = frequencies(age_distribution(df), "age")
    median = "percentile(age, 0.5D, n)"
    if not exact:
        rough = age_distribution(df).agg(*exprs(f"percentile_approx(age, 0.5D, {ACCURACY}) AS m"))
        freq, median = freq.withColumn("rough", as_value(rough)), "max(rough.m)"
    whole = freq.agg(*exprs("min(age) AS low", "sum(age * n) / sum(n) AS mean", f"{median} AS median"))
    return (
        freq.withColumn("whole", as_value(whole))
        .groupBy(F.expr(f"whole.low + floor((age - whole.low) / {width}) * {width}").alias("bin_start"))
        .agg(*exprs("sum(n) AS reviews", "max(whole.mean) AS mean_age", "max(whole.median) AS median_age"))
        .selectExpr("bin_start", f"bin_start + {width} AS bin_end", "reviews", "mean_age", "median_age")
        .orderBy("bin_start")
    )


def review_length_box(df: DataFrame, exact: bool = True) -> DataFrame:
    """Box figures of the word count per sentiment, over reviews with text.

    The fences are the outermost lengths within 1.5 quartile distances of the box. With
    ``exact=False`` quartiles come from a sketch, ranks off by 1/ACCURACY at most, and a second
    pass finds the fences.
    """
    rows = df.filter(F.col("has_review_text") & F.col("sentiment").isin(*SENTIMENTS))
    if not exact:
        words = rows.selectExpr("sentiment", "double(review_length_words) AS v")
        boxes = words.groupBy("sentiment").agg(
            *exprs(f"percentile_approx(v, array(0.25D, 0.5D, 0.75D), {ACCURACY}) AS q")
        )
        within = "v BETWEEN q[0] - 1.5D * (q[2] - q[0]) AND q[2] + 1.5D * (q[2] - q[0])"
        return (
            words.join(boxes, "sentiment").groupBy("sentiment")
            .agg(
                *exprs(
                    "count(1) AS reviews", "avg(v) AS mean", "max(q[0]) AS q1", "max(q[1]) AS median", "max(q[2]) AS q3",
                    f"min(v) FILTER (WHERE {within}) AS lower_fence", f"max(v) FILTER (WHERE {within}) AS upper_fence",
                )
            )
            .orderBy("sentiment")
        )
    freq = frequencies(rows, "sentiment", "double(review_length_words) AS v")
    inside = "v BETWEEN q[0] - 1.5D * (q[2] - q[0]) AND q[2] + 1.5D * (q[2] - q[0])"
    quartiles = "percentile(v, array(0.25D, 0.5D, 0.75D), n) OVER (PARTITION BY sentiment)"
    return (
        freq.selectExpr("*", f"{quartiles} AS q")
        .groupBy("sentiment")
        .agg(
            *exprs(
                "sum(n) AS reviews",
                "sum(v * n) / sum(n) AS mean",
                "max(q[0]) AS q1",
                "max(q[1]) AS median",
                "max(q[2]) AS q3",
                f"min(v) FILTER (WHERE {inside}) AS lower_fence",
                f"max(v) FILTER (WHERE {inside}) AS upper_fence",
            )
        )
        .orderBy("sentiment")
    )
