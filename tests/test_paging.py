"""Pages through an index against the whole sorted list."""

import random

import pytest

from tallyloom.operators import browse
from tallyloom.operators.paging import build_page_index


@pytest.fixture(scope="module")
def reviews(clean):
    rng = random.Random(8)
    ids = rng.sample(range(5000), 400)
    return clean(*[
        dict(row_id=i, rating=rng.choice([1.0, 5.0, 5.0, 5.0, None]), age=rng.choice([None, *map(float, range(18, 70))]),
             positive_feedback_count=rng.choice([0.0, 0.0, 0.0, 1.0, 2.0, 30.0, None]), clothing_id=float(rng.randrange(300)),
             review_text=rng.choice(["a", "a b c", "w " * 40]))
        for i in ids
    ])


@pytest.mark.parametrize("sort", list(browse.SORTS))
def test_pages_equal_the_sorted_list(reviews, sort):
    matches = browse.matching_reviews(reviews)
    everything = [r.row_id for r in browse.sorted_reviews(matches, sort).collect()]
    index = build_page_index(matches, sort, parts=16)
    assert index.matches == len(everything) == 400
    # However often a key occurs, no range holds much more than an even share.
    assert max(n for _, _, n in index.ranges) <= 2 * 400 / 16 + 2
    for page in (1, 2, 7, 16, 17, 18):
        found = [(r.position, r.row_id) for r in index.page(matches, page, 25).collect()]
        start = (page - 1) * 25
        assert found == [(start + k + 1, i) for k, i in enumerate(everything[start : start + 25])]


def test_a_deep_page_reads_a_narrow_range(tables):
    matches = browse.matching_reviews(tables.clean)
    index = build_page_index(matches, "Rating (low to high)", parts=32)
    page = index.page(matches, index.matches // 25)
    plan = page.sparkSession._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.split("\n") if "PushedFilters" in line and "row_id" in line)
    assert "EqualTo(rating" in pushed or "IsNull(rating" in pushed
    ends = sum(n for _, _, n in index.ranges)
    assert ends == matches.count() and max(n for _, _, n in index.ranges) <= 2 * ends / 32 + 2


def test_empty_lists_and_pages_beyond_the_end(clean):
    matches = browse.matching_reviews(clean({}, {}))
    index = build_page_index(matches, parts=4)
    assert index.page(matches, 1).count() == 2 and index.page(matches, 2).count() == 0
    nothing = matches.filter("false")
    empty = build_page_index(nothing)
    assert empty.matches == 0 and empty.page(nothing, 1).count() == 0


def test_a_stored_list_is_made_once_for_all_orders(reviews, tmp_path):
    from tallyloom.operators.paging import store_list

    matches = browse.matching_reviews(reviews)
    listed = store_list(matches, str(tmp_path / "list"))
    for sort in ("Review length (long to short)", "Clothing ID"):
        wanted = [(r.position, r.row_id) for r in browse.review_page(matches, 3, 25, sort).collect()]
        page = build_page_index(listed, sort, parts=16).page(listed, 3)
        assert [(r.position, r.row_id) for r in page.collect()] == wanted
        assert "review_text" not in page._jdf.queryExecution().executedPlan().toString()
