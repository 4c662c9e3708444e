import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

RAW_SCHEMA = (
    "row_id bigint, clothing_id double, age double, title string, review_text string, rating double, "
    "recommended_ind double, positive_feedback_count double, division_name string, "
    "department_name string, class_name string"
)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tallyloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Build a raw table from partial rows; what is not given has a harmless default."""

    def build(*rows):
        names = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
        full = []
        for i, row in enumerate(rows):
            values = {
                "row_id": i, "clothing_id": 1.0, "age": 30.0, "title": "title", "review_text": f"text {i}",
                "rating": 5.0, "recommended_ind": 1.0, "positive_feedback_count": 0.0,
                "division_name": "D", "department_name": "P", "class_name": "C",
            } | row
            full.append(tuple(values[n] for n in names))
        return spark.createDataFrame(full, RAW_SCHEMA)

    return build


@pytest.fixture(scope="session")
def clean(raw):
    from tallyloom.operators.cleaning import clean_reviews

    return lambda *rows: clean_reviews(raw(*rows))


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """The smallest data set with its clean layer stored once for all tests."""
    from tallyloom.plans.queries import ReviewTables

    lazy = ReviewTables.from_folder(spark, "/root/testdata/sf0.001")
    return lazy.stored(str(tmp_path_factory.mktemp("layer") / "clean"))
