"""KPIs, distributions, segments, filters, facets, validation, lists and insights on small frames."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import (
    browse, distributions, facets, filters, insights, kpis, segments, validation,
)
from tallyloom.operators.validation import Expectation


def dicts(df):
    return [r.asDict() for r in df.collect()]


# KPIs ---------------------------------------------------------------------------------------
def test_empty_table_has_zero_kpis(clean):
    found = kpis.compute_kpis(clean({}).limit(0)).first().asDict()
    assert tuple(found) == kpis.KPI_COLUMNS and set(found.values()) == {0}


def test_all_missing_values_have_mean_zero_and_no_median(clean):
    row = dict(rating=None, age=None, recommended_ind=None, positive_feedback_count=None, review_text=None, clothing_id=None)
    found = kpis.compute_kpis(clean(row)).first()
    assert (found.total_records, found.average_rating, found.median_rating, found.median_age) == (1, 0.0, None, None)
    assert (found.recommendation_rate, found.average_review_length, found.unique_clothing_ids) == (0.0, 0.0, 0)


def test_rates_have_their_own_denominators(clean):
    table = clean(
        dict(rating=1.0, recommended_ind=1.0), dict(rating=5.0, recommended_ind=0.0),
        dict(rating=7.0, recommended_ind=2.0), dict(rating=None, recommended_ind=None),
    )
    kpi = kpis.compute_kpis(table).first()
    assert kpi.negative_rate == 50.0 and kpi.recommendation_rate == 50.0
    segment = segments.division_performance(table).first()
    assert segment.recommendation_rate == pytest.approx(100 / 3) and segment.negative_rate == 50.0
    assert kpi.average_rating == pytest.approx(13 / 3)


def test_largest_vote_count_and_validity(clean):
    assert kpis.largest_vote_count(clean(dict(positive_feedback_count=None))).first()[0] == 0
    assert kpis.largest_vote_count(clean(dict(positive_feedback_count=7.0))).first()[0] == 7
    assert kpis.domain_validity(clean({})).first().passed
    assert not kpis.domain_validity(clean(dict(rating=4.5))).first().passed


# Distributions ------------------------------------------------------------------------------
def test_distributions_are_zero_filled_and_ordered(clean):
    table = clean(dict(rating=4.5), dict(rating=5.0), dict(rating=9.0))
    assert [(r["sentiment"], r["reviews"], r["share"]) for r in dicts(distributions.sentiment_distribution(table))] == [
        ("Negative", 0, 0.0), ("Neutral", 0, 0.0), ("Positive", 2, 100.0),
    ]
    stars = dicts(distributions.rating_distribution(table))
    assert [r["rating_label"] for r in stars] == ["1 star", "2 stars", "3 stars", "4 stars", "5 stars"]
    assert [r["reviews"] for r in stars] == [0, 0, 0, 0, 1]
    cells = dicts(distributions.recommendation_by_sentiment(table))
    assert len(cells) == 6 and cells[5]["reviews"] == 2 and cells[5]["share"] == 100.0
    empty = table.limit(0)
    assert [r["share"] for r in dicts(distributions.recommendation_distribution(empty))] == [0.0, 0.0]
    assert [r["median_helpful_votes"] for r in dicts(distributions.helpful_votes_by_sentiment(empty))] == [0.0] * 3


def test_numeric_summary(clean):
    table = clean(*[dict(age=a, rating=None) for a in (1.0, 2.0, 3.0, 4.0)])
    found = {r["measure"]: r for r in dicts(distributions.numeric_summary(table))}
    assert set(found) == {"age", "positive_feedback_count", "review_length_words"}
    age = found["age"]
    assert (age["p25"], age["median"], age["p75"], age["count"]) == (1.75, 2.5, 3.25, 4)
    assert age["std_dev"] == pytest.approx(1.2909944487358056)
    assert dicts(distributions.numeric_summary(clean({})))[0]["std_dev"] == 0.0


def test_histogram_and_box(clean):
    table = clean(*[dict(age=a, rating=1.0, review_text=" ".join("w" * n)) for a, n in ((18.0, 1), (22.9, 2), (23.0, 3), (40.0, 50))])
    assert [(r["bin_start"], r["reviews"]) for r in dicts(distributions.age_histogram(table))] == [(18.0, 2), (23.0, 1), (38.0, 1)]
    (box,) = dicts(distributions.review_length_box(table))
    assert (box["q1"], box["median"], box["q3"]) == (1.75, 2.5, 14.75)
    assert (box["lower_fence"], box["upper_fence"]) == (1.0, 3.0)


# Segments -----------------------------------------------------------------------------------
def test_small_segments_are_absent_and_baselines_keep_them(clean):
    table = clean(*[dict(class_name="A")] * 3, dict(class_name="B", rating=1.0))
    (row,) = dicts(segments.class_performance_matrix(table, min_reviews=2, cell_bands=True))
    assert row["product_class"] == "A" and row["performance"] == "Strong" and row["negative_band"] == "Strong"
    (segment,) = dicts(segments.segment_performance(table, "class_name", 2))
    assert segment["share"] == 75.0


def test_ties_go_by_name_and_bands_have_their_order(clean):
    table = clean(*[dict(class_name=c, age=a) for c, a in (("b", 65.0), ("a", 20.0), ("c", None))])
    assert [r["class_name"] for r in dicts(segments.top_classes_by_volume(table, 2))] == ["a", "b"]
    assert [r["age_band"] for r in dicts(segments.age_band_performance(table))] == ["18-29", "60+", "Unknown"]


def test_any_column_can_be_a_segment(clean):
    table = clean(dict(clothing_id=1.0), dict(clothing_id=2.0), dict(clothing_id=2.0))
    found = dicts(segments.segment_performance(table, "clothing_id"))
    assert [(r["clothing_id"], r["share"]) for r in found] == [(2.0, pytest.approx(200 / 3)), (1.0, pytest.approx(100 / 3))]
    absent = segments.segment_performance(table, "colour")
    assert absent.columns == ["colour", *segments.MEASURES] and absent.count() == 0
    assert segments.department_performance(table.limit(0)).count() == 0


# Filters and facets -------------------------------------------------------------------------
def test_filters_intersect_and_empty_means_all(clean):
    table = clean(dict(division_name="A"), dict(division_name="A", rating=4.5), dict(division_name="B", rating=None))
    ids = lambda **choice: sorted(r.row_id for r in filters.apply_filters(table, **choice).collect())
    assert ids() == ids(divisions=[]) == [0, 1, 2]
    assert ids(divisions=["A"], ratings=[5]) == [0] and ids(ratings=[4]) == []
    assert ids(sentiments=["Unknown"]) == [2] and ids(divisions=["A"], sentiments=["Unknown"]) == []
    assert filters.scope_size(table, divisions=["A"], ratings=[5]).first() == (1, 3, pytest.approx(100 / 3))
    assert filters.scope_size(table.limit(0), divisions=["A"]).first() == (0, 0, 0.0)


def test_keywords_are_literal_and_may_span_text_and_title(clean):
    table = clean(
        dict(review_text="100% Cotton", title="a_b"), dict(review_text="fits", title="well."), dict(review_text=None, title=None),
    )
    ids = lambda term: sorted(r.row_id for r in filters.search_reviews(table, term).collect())
    assert ids("  ") == [0, 1, 2] and ids("0% c") == [0] and ids("%") == [0] and ids("_") == [0]
    assert ids("S WELL") == [1] and ids(".") == [1] and ids("untitled") == [2] and ids("f.ts") == []


def test_scopes(clean):
    table = clean(dict(department_name="X"), dict(department_name=" "), dict(department_name="Y"))
    size = lambda *a: filters.resolve_scope(table, *a).count()
    assert size("By Department", ["X"]) == 1 and size("By Department", [" "]) == 3 and size("Elsewhere", ["X"]) == 3
    assert filters.resolve_scope(table.drop("department_name"), "By Department", ["X"]).count() == 0
    assert [r[0] for r in facets.available_categories(table, "By Department").collect()] == ["X", "Y"]
    assert facets.available_categories(table, "All filtered data").count() == 0


def test_facets_cascade_in_canonical_order(clean):
    table = clean(
        dict(division_name="A", department_name="P", class_name="x", rating=10.0, age=70.0),
        dict(division_name="B", department_name="Q", class_name="y", rating=2.0, age=None),
    )
    found = facets.facet_values(table, ["A"], ["P"])
    offered = {}
    for r in found.collect():
        offered.setdefault(r.facet, []).append(r.value)
    assert offered["division"] == ["A", "B"] and offered["department"] == ["P"] and offered["class"] == ["x"]
    assert offered["rating"] == ["2", "10"] and offered["age_band"] == ["60+", "Unknown"]
    assert offered["sentiment"] == ["Negative"]
    kept = facets.keep_offered(found, {"class": ["x", "y"], "rating": [2]}).collect()
    assert {tuple(r) for r in kept} == {("class", "x"), ("rating", "2")}
    assert facets.keep_offered(found, {}).count() == 0


# Validation ---------------------------------------------------------------------------------
def test_validation(clean):
    checks = [
        Expectation("total_records", "Rows", 2), Expectation("average_rating", "Stars", 4.5, 0.5, "rating"),
        Expectation("negative_rate", "Bad", 1.0, 0.5, "percent"),
    ]
    table = clean(dict(rating=4.0), dict(rating=5.0))
    found = validation.validation_table(table, checks).collect()
    assert [r.status for r in found] == ["Match", "Match", "Deviation"]
    assert [r.calculated_text for r in found] == ["2", "4.500", "0.00%"]
    assert [r.difference_text for r in found] == ["+0", "+0.000", "-1.000"]
    assert validation.validation_summary(table, checks).first() == (3, 2, 1, ["Bad"], False)
    assert len(validation.PUBLISHED) == 15 and validation.validation_table(table).count() == 15


# Lists --------------------------------------------------------------------------------------
def test_most_helpful_reviews_break_ties_by_length_then_order(clean):
    table = clean(
        dict(positive_feedback_count=3.0, review_text="a"), dict(positive_feedback_count=3.0, review_text="a b"),
        dict(positive_feedback_count=3.0, review_text="c d"), dict(positive_feedback_count=9.0, review_text=None),
        dict(positive_feedback_count=None, review_text="n", rating=1.0),
    )
    found = browse.most_helpful_reviews(table, 3).collect()
    assert [(r["rank"], r.row_id) for r in found] == [(1, 1), (2, 2), (3, 0)]
    assert [r.helpful_votes for r in browse.most_helpful_reviews(table, 3, True).collect()] == [0]


@pytest.mark.parametrize("sort", browse.SORTS)
def test_pages_join_up(clean, sort):
    values = [3.0, None, 1.0, 3.0, 2.0, None, 1.0]
    table = clean(*[dict(rating=v, age=v, clothing_id=v, positive_feedback_count=v) for v in values])
    everything = [r.row_id for r in browse.sorted_reviews(table, sort).collect()]
    pages = [browse.review_page(table, p, 3, sort).collect() for p in (1, 2, 3, 4)]
    assert [r.row_id for page in pages for r in page] == everything
    assert [r.position for page in pages for r in page] == list(range(1, 8))
    for before, page in zip(pages, pages[1:]):
        last = table.filter(f"row_id = {before[-1].row_id}").first() if before else None
        if last:
            after = browse.review_page_after(table, last, 3, sort).collect()
            assert [r.row_id for r in after] == [r.row_id for r in page]
    column, ascending = browse.SORTS[sort]
    if column != "review_length_words":
        given = [values[i] for i in everything]
        assert given[5:] == [None, None]
        assert given[:5] == sorted(given[:5], reverse=not ascending)


def test_page_summary(clean):
    table = clean(*[{}] * 7)
    assert tuple(browse.page_summary(table, 3, 3).first()) == (7, 3, 7, 7)
    assert tuple(browse.page_summary(table.limit(0), 1, 3).first()) == (0, 1, 1, 0)


# Insights -----------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "build", [insights.executive_insights, insights.product_insights, insights.customer_insights]
)
def test_insights_fall_back_to_one_row(clean, build):
    for table, minimum in ((clean({}), 2), (clean({}).limit(0), 0)):
        (row,) = build(table, minimum).collect()
        assert row.insight == "Too few reviews" and row.value is None


def test_insights_name_the_extremes(clean):
    table = clean(
        *[dict(department_name="Bad", class_name="Bad", rating=1.0, recommended_ind=0.0, age=20.0)] * 2,
        *[dict(department_name="Good", class_name="Good", age=50.0)] * 3,
        dict(department_name="Small", class_name="Small", rating=2.0, positive_feedback_count=9.0,
             review_text="x" * 300, recommended_ind=0.0, age=50.0),
    )
    found = {r.insight: r for r in insights.executive_insights(table, 2).collect()}
    assert [found[k].segment for k in list(found)[:4]] == ["Good", "Good", "Bad", "Good"]
    assert found["Most negative department"].baseline == 50.0 and found["Most negative department"].delta == 50.0
    assert found["Text coverage"].value == 100.0
    products = {r.insight: r for r in insights.product_insights(table, 1).collect()}
    flagged = products["Classes that need attention"]
    assert flagged.segment == "Bad (100.0%), Small (100.0%)" and flagged.value == 2 and flagged.reviews == 3
    customers = {r.insight: r for r in insights.customer_insights(table, 1).collect()}
    assert customers["Age band that recommends most"].segment == "50-59"
    critic = customers["Most helpful negative review"]
    assert critic.value == 9.0 and critic.narrative.endswith("x" * 257 + "...")
    assert all(r.narrative for r in (*found.values(), *products.values(), *customers.values()))


def test_no_votes_no_vote_insight(clean):
    titles = [r.insight for r in insights.customer_insights(clean({}), 1).collect()]
    assert titles == ["Age band that recommends most", "Age band with the lowest rating"]


def test_words_of_reviews_that_can_not_be_listed_are_not_counted(clean):
    table = clean(*({"review_text": f"{'word ' * (i % 4)}{i}", "positive_feedback_count": float(i % 5) if i % 7 else None, "rating": 1.0} for i in range(60)))
    votes = F.coalesce("positive_feedback_count", F.lit(0.0))
    counted = F.when(votes < 4, F.raise_error(F.lit("counted")).cast("int")).otherwise(F.col("review_length_words"))
    watched = table.withColumn("review_length_words", counted)
    for negative in (False, True):
        expected = table.orderBy(votes.desc(), F.desc("review_length_words"), "row_id").limit(3).collect()
        found = browse.most_helpful_reviews(watched, 3, negative).collect()
        assert [r.row_id for r in found] == [r.row_id for r in expected]
    assert [r.row_id for r in browse.most_helpful_reviews(table, 100).collect()] == [
        r.row_id for r in table.orderBy(votes.desc(), F.desc("review_length_words"), "row_id").collect()
    ]
    assert browse.most_helpful_reviews(table.limit(0), 3).count() == 0
