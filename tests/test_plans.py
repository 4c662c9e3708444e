"""The shape of the plans: what is read, shuffled and broadcast; and independence of layout."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyloom.names import TEXT_SPELLING
from tallyloom.operators import cleaning, distributions, duplicates, filters, kpis, scenario, segments
from tallyloom.plans.oracle import ORACLE_SQL
from tallyloom.plans.queries import QUERIES, WRITES, ReviewTables


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def read_columns(text: str) -> set[str]:
    return {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in schema.split(",")}


def test_every_query_has_an_oracle_and_the_entry_runs(spark):
    assert set(ORACLE_SQL) == set(QUERIES) <= set(__spark_entry__.queries())
    assert ORACLE_SQL.items() <= __spark_entry__.oracle_sql().items()
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_python_and_no_cartesian_product(tables, name):
    text = plan(QUERIES[name](tables))
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_views_read_only_their_columns(tables):
    text = plan(segments.department_performance(tables.clean))
    assert read_columns(text) == {
        "department_name", "rating", "recommended_ind", "sentiment", "positive_feedback_count", "has_review_text",
    }
    assert read_columns(plan(distributions.sentiment_distribution(tables.clean))) == {"sentiment"}
    assert not {"title", "review_text"} & read_columns(plan(kpis.compute_kpis(tables.clean)))


def test_filters_reach_the_scan(tables):
    text = plan(filters.apply_filters(tables.clean, divisions=["ASIA"], ratings=[1, 2], has_review_text=filters.WITH_TEXT))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    for part in ("division_name", "In(rating, [1.0,2.0])", "has_review_text"):
        assert part in pushed


def test_unused_duplicate_flag_costs_nothing(spark, raw, tmp_path):
    raw({}).write.parquet(str(tmp_path / "raw"))
    cleaned = cleaning.clean_reviews(spark.read.parquet(str(tmp_path / "raw")))
    assert "Join" not in plan(cleaned.groupBy("sentiment").count())
    assert "Join" in plan(cleaned.filter("is_duplicate_review_text"))


def test_windows_run_on_sums_only(tables):
    """Below every window there is an aggregate; without partitions there is none over the reviews."""
    for name in QUERIES:
        if name in WRITES:
            continue
        lines = plan(QUERIES[name](tables)).split("\n")
        for i, line in enumerate(lines):
            if re.search(r"\bWindow \[", line):
                assert any("HashAggregate" in later for later in lines[i:]), name


def test_no_text_is_shuffled_for_the_layer(spark, raw, tmp_path):
    raw({}).write.parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    cleaned = cleaning.clean_rows(stored)
    for df in (cleaned, duplicates.repeated_review_rows(cleaned)):
        tree = df._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in tree.split("\n") if "Exchange hashpartitioning" in line]
        assert not any(c in line for line in shuffled for c in ("title#", "review_text#"))


def shuffled_texts(df) -> list[str]:
    """Exchanges that move a review's text."""
    lines = plan(df).split("\n")
    starts = [i for i, line in enumerate(lines) if re.match(r"\(\d+\) Exchange", line)]
    return [lines[i + 1] for i in starts if re.search(r"\breview_text#", lines[i + 1])]


@pytest.mark.parametrize("name", ["quality_report", "quality_summary"])
def test_no_text_is_shuffled_for_the_quality_of_a_table(spark, raw, tmp_path, name):
    """The flag is joined to digests; where the clean table has none, to texts, with equal results."""
    rows = [{"review_text": t} for t in ("Same", "same", "same", " same", "other", None, "No Review Text")]
    raw(*rows).write.parquet(str(tmp_path / "raw"))
    table = ReviewTables(spark.read.parquet(str(tmp_path / "raw")))
    plain = ReviewTables(table.raw)
    plain.__dict__["spelled"] = table.clean
    assert table.spelled.drop(TEXT_SPELLING).columns == table.clean.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not shuffled_texts(QUERIES[name](table)) and shuffled_texts(QUERIES[name](plain))
        assert QUERIES[name](table).collect() == QUERIES[name](plain).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SCENARIOS = sorted(n for n in QUERIES if n.startswith("scenario_") or n == "insights_scenario")


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios_read_the_ledger(tables, name):
    """No quantiles are taken; reviews are ranked only where a simulated rating is asked for, and read once for it."""
    text = plan(QUERIES[name](tables))
    assert "percentile_approx" not in text
    counts_only = name in ("scenario_movement", "scenario_sentiment_comparison", "insights_scenario")
    assert ("row_number" in text) != counts_only
    reviews = {line for line in re.findall(r"Location: .*", text) if "/reviews" in line}
    assert len(reviews) == (0 if counts_only else 1)


def test_counts_do_not_pay_for_ratings_without_a_ledger(tables):
    text = plan(scenario.movement_steps(scenario.run_simulation(tables.clean)))
    assert "row_number" not in text and "percentile_approx" not in text and "Join" not in text


@pytest.mark.parametrize("parts", [1, 17])
def test_results_do_not_depend_on_the_layout(tables, parts):
    moved = tables.clean.repartition(parts, "review_length_words")
    for build in (
        kpis.compute_kpis,
        segments.class_performance_matrix,
        lambda df: scenario.department_simulation(df),
        lambda df: distributions.numeric_summary(df).withColumn("std_dev", F.round("std_dev", 6)),
    ):
        assert build(moved).collect() == build(tables.clean).collect()


def test_heavily_repeated_text_is_flagged_without_a_hot_partition(spark, raw, tmp_path):
    """A third of all rows share one text: they never meet in the join by digest."""
    base = raw({}).drop("row_id", "review_text")
    rows = spark.range(3000).crossJoin(base).selectExpr(
        "id AS row_id", "CASE WHEN id % 3 = 0 THEN 'Good' WHEN id % 3 = 1 THEN NULL ELSE concat('t', id) END AS review_text",
        *base.columns,
    )
    rows.write.parquet(str(tmp_path / "raw"))
    cleaned = cleaning.clean_reviews(spark.read.parquet(str(tmp_path / "raw")))
    found = cleaned.groupBy("is_duplicate_review_text").count().collect()
    assert {r[0]: r[1] for r in found} == {True: 1000, False: 2000}


def test_many_texts_above_an_even_share(spark, raw):
    """5,000 repeated texts, each with more rows than an even share of 20,000 partitions."""
    base = raw({}).drop("row_id", "review_text")
    rows = spark.range(15000).crossJoin(base).selectExpr("id AS row_id", "concat('t', id % 6000) AS review_text", *base.columns)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20000)
    try:
        ids = duplicates.repeated_review_rows(cleaning.clean_rows(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ids.count() == 15000


def test_texts_are_digested_once_for_the_flag(spark, raw, tmp_path):
    raw({}).write.parquet(str(tmp_path / "raw"))
    cleaned = cleaning.clean_rows(spark.read.parquet(str(tmp_path / "raw")))
    tree = duplicates.repeated_review_rows(cleaned)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("sha2(") == 1 and tree.count("FileScan") == 1


@pytest.mark.parametrize("slices", [1, 2, 7])
def test_repeated_texts_are_found_across_slices(spark, raw, slices):
    """Texts of one to nine reviews, ids that come twice, and a placeholder that is a review's own text."""
    rows = [dict(row_id=100 * n + i, review_text=f"Text {n}" if i % 2 else f" TEXT {n} ") for n in range(1, 10) for i in range(n)]
    rows += [dict(row_id=5000, review_text="one"), dict(row_id=5000, review_text="two"), dict(row_id=5001, review_text="Two")]
    rows += [dict(row_id=6000, review_text="no review text"), dict(row_id=6001, review_text=None), dict(row_id=6002, review_text=None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        found = sorted(r._row for r in duplicates.repeated_review_rows(cleaning.clean_rows(raw(*rows))).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == sorted([100 * n + i for n in range(2, 10) for i in range(n)] + [5000, 5001, 6000])
