"""Every query on the smallest data set against DuckDB."""

import pytest

from oracle import connect, differences
from tallyloom.plans.oracle import ORACLE_SQL
from tallyloom.plans.queries import QUERIES, ReviewTables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_stored_layer(tables, duck, name):
    assert differences(QUERIES[name](tables), duck, ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", ["clean_reviews", "kpis", "quality_summary", "scenario_department", "insights_product"])
def test_straight_from_the_tables(spark, duck, name):
    assert differences(QUERIES[name](ReviewTables.from_folder(spark, FOLDER)), duck, ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", ["review_excerpts", "clean_texts"])
def test_texts_of_the_larger_tables(spark, name):
    """Line ends at the place where an excerpt is cut occur in the larger tables only."""
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](ReviewTables.from_folder(spark, folder)), connect(folder), ORACLE_SQL[name]) == []
