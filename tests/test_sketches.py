"""Stored sketches against exact figures, for any selection of cells."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import sketches
from tallyloom.sources.layers import append_reviews, open_clean_layer, write_clean_layer


@pytest.fixture(scope="module")
def layer(spark, raw, tmp_path_factory):
    base = raw({}).drop("row_id", "age", "rating", "review_text", "clothing_id", "department_name")
    rows = spark.range(12000).crossJoin(base).selectExpr(
        "id AS row_id", "double(id * 7919 % 5003) AS age", "double(1 + id % 5) AS rating", "double(id % 3001) AS clothing_id",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE repeat('w ', int(1 + id % 40)) END AS review_text",
        "CASE WHEN id % 3 = 0 THEN 'A' ELSE 'B' END AS department_name", *base.columns,
    ).select(*raw({}).columns)
    path = str(tmp_path_factory.mktemp("sketches") / "layer")
    write_clean_layer(rows.filter("row_id < 7000"), path, sketches=True)
    append_reviews(rows.filter("row_id >= 7000"), path)
    return open_clean_layer(spark, path)


@pytest.mark.parametrize("condition", ["true", "department_name = 'A'", "sentiment = 'Negative'", "sentiment = 'Neutral' AND department_name = 'B'"])
def test_quantiles_keep_to_their_rank_error(layer, condition):
    shares = (0.1, 0.25, 0.5, 0.75, 0.99)
    found = {r.measure: r for r in sketches.estimated_quantiles(layer.sketches.filter(condition), shares).collect()}
    assert set(found) == set(sketches.MEASURES)
    for measure, value in sketches.MEASURES.items():
        values = [r.x for r in layer.clean.filter(condition).select(value(measure).cast("double").alias("x")).collect() if r.x is not None]
        assert found[measure].n == len(values)
        for i, share in enumerate(shares, 1):
            estimate = found[measure][f"q{i}"]
            below, up_to = sum(v < estimate for v in values), sum(v <= estimate for v in values)
            slack = sketches.RANK_ERROR * len(values) + 1
            assert below <= share * len(values) + slack and up_to >= share * len(values) - slack, (measure, share)


def test_distinct_counts_per_segment(layer):
    found = {r.segment: r.distinct_values for r in sketches.estimated_distinct(layer.sketches, by="department_name").collect()}
    for name, estimate in found.items():
        exact = layer.clean.filter(F.col("department_name") == name).select("clothing_id").distinct().count()
        assert abs(estimate - exact) <= 4 * sketches.DISTINCT_ERROR * exact
    assert set(found) == {"A", "B"}


def test_sketches_alone_are_read(layer):
    for df in (sketches.estimated_quantiles(layer.sketches), sketches.estimated_distinct(layer.sketches)):
        assert all("/sketches/" in f for f in df.inputFiles())


def test_few_values_are_exact_and_none_are_null(spark, clean):
    table = clean({"age": 20.0}, {"age": 40.0}, {"age": 30.0}, {"age": None, "class_name": "empty"})
    cells = sketches.build_sketches(table)
    assert {r.measure: (r.n, r.q1) for r in sketches.estimated_quantiles(cells, (0.5,)).collect()}["age"] == (3, 30.0)
    empty = sketches.estimated_quantiles(cells.filter("class_name = 'empty'"), (0.5,)).collect()
    assert {r.measure: (r.n, r.q1) for r in empty}["age"] == (0, None)
