"""Versions of a layer: readers see all of a version or nothing of it."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import kpis, scenario
from tallyloom.sources import layers
from tallyloom.sources.digests import merge_digests, open_digests
from tallyloom.sources.layers import append_reviews, open_clean_layer, read_clean_layer, replace_layer, write_clean_layer
from tallyloom.sources.schema_check import DatasetError
from tallyloom.sources.versions import VersionedTables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tallyloom.sources import layers
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
layers.repeated_review_rows = lambda *a: os._exit(9)
layers.write_clean_layer(spark.read.parquet({raw!r}), {path!r})
"""


def ids(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


def test_a_writer_killed_between_tables_leaves_the_old_version(spark, raw, tmp_path):
    path = str(tmp_path / "layer")
    write_clean_layer(raw({"row_id": 1, "review_text": "a"}, {"row_id": 2, "review_text": "a"}), path)
    raw({"row_id": 3}).write.parquet(str(tmp_path / "raw"))
    code = KILLED.format(root=ROOT, raw=str(tmp_path / "raw"), path=path)
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=300).returncode == 9
    assert len(os.listdir(tmp_path / "layer" / "data")) == 2
    _, clean = read_clean_layer(spark, path)
    assert ids(clean) == [1, 2] and ids(clean.filter("is_duplicate_review_text")) == [1, 2]
    second = write_clean_layer(raw({"row_id": 4}), path)
    assert second.number == 2 and ids(read_clean_layer(spark, path)[1]) == [4]
    VersionedTables(spark, path).expire(keep=1)
    assert os.listdir(tmp_path / "layer" / "data") == [second.notes["data"]]


def test_readers_stay_with_the_version_they_opened(spark, raw, tmp_path):
    path = str(tmp_path / "layer")
    first = write_clean_layer(raw({"row_id": 1}), path)
    opened = open_clean_layer(spark, path)
    write_clean_layer(raw({"row_id": 2}, {"row_id": 3}), path)
    assert ids(opened.clean) == [1] and opened.version.notes["rows"] == 1
    assert ids(open_clean_layer(spark, path).clean) == [2, 3]
    assert ids(open_clean_layer(spark, path, first.number).raw) == [1]
    with pytest.raises(DatasetError):
        open_clean_layer(spark, path, 7)
    with pytest.raises(DatasetError):
        open_clean_layer(spark, str(tmp_path / "nothing"))


def test_torn_manifests_are_passed_over_and_their_numbers_stay_taken(spark, raw, tmp_path):
    path = str(tmp_path / "layer")
    write_clean_layer(raw({"row_id": 1}), path)
    whole = (tmp_path / "layer" / "versions" / "0000000001.json").read_text()
    (tmp_path / "layer" / "versions" / "0000000002.json").write_text(whole[: len(whole) // 2])
    assert ids(read_clean_layer(spark, path)[1]) == [1]
    assert write_clean_layer(raw({"row_id": 5}), path).number == 3
    assert ids(read_clean_layer(spark, path)[1]) == [5]


def test_writers_at_the_same_time_get_numbers_of_their_own(spark, raw, tmp_path, monkeypatch):
    path = str(tmp_path / "layer")
    tables = VersionedTables(spark, path)
    notes = {"tables": []}
    first = tables.commit(tables.new_folder(), notes)
    # The second writer has looked before the first one committed.
    late = VersionedTables(spark, path)
    seen = iter([[], [first.number]])
    monkeypatch.setattr(late, "numbers", lambda: next(seen))
    assert late.commit(late.new_folder(), notes).number == 2
    assert VersionedTables(spark, path).numbers() == [1, 2]
    assert VersionedTables(spark, path).version(1).notes["data"] == first.notes["data"]


def test_a_candidate_replaces_the_layer_only_if_it_is_usable(spark, raw, tmp_path):
    path = str(tmp_path / "layer")
    write_clean_layer(raw({"row_id": 1}), path)
    kept, report = replace_layer(raw({"row_id": 2}).drop("rating"), path)
    assert kept.number == 1 and report.missing_required == ("rating",)
    new, report = replace_layer(raw({"row_id": 2}).withColumn("extra", F.lit(1)), path)
    assert new.number == 2 and report.is_usable and ids(read_clean_layer(spark, path)[1]) == [2]


def test_views_of_a_layer_equal_those_of_its_reviews(spark, tables):
    rows = tables.clean.filter("row_id % 7 < 5")
    assert kpis.compute_kpis(rows).collect() == kpis.compute_kpis(rows.repartition(3)).collect()
    for by in (None, "department_name", "class_name", "clothing_id"):
        stored = scenario.run_simulation(tables.clean, by=by, ledger=tables.ledger)
        assert sorted(map(str, stored.collect())) == sorted(map(str, scenario.run_simulation(tables.clean, by=by).collect()))
    labels = ["ASIA", "EUROPE"]
    scoped = tables.clean.filter(F.col("division_name").isin(labels))
    ledger = tables.ledger.scoped("division_name", labels)
    assert scenario.run_simulation(scoped, ledger=ledger).collect() == scenario.run_simulation(scoped).collect()


def batches(raw, parts=3):
    """Reviews with repeated, missing and placeholder texts, dealt into parts."""
    texts = ["one", "Two ", " two", None, "No Review Text", "three", "THREE", None, "four", "five", "one", "six", "four", "  ", "no review text"]
    rows = [{"row_id": 10 * i, "review_text": t, "rating": float(1 + i % 5), "department_name": "PQ"[i % 2]} for i, t in enumerate(texts)]
    return raw(*rows), [raw(*rows[i::parts]) for i in range(parts)]


def test_appended_batches_equal_one_layer(spark, raw, tmp_path):
    whole, parts = batches(raw)
    write_clean_layer(whole, str(tmp_path / "one"))
    one = open_clean_layer(spark, str(tmp_path / "one"))
    path = str(tmp_path / "parts")
    write_clean_layer(parts[0], path, search_index=True)
    for part in parts[1:]:
        append_reviews(part, path)
    many = open_clean_layer(spark, path)
    assert many.version.number == 3 and many.version.notes["rows"] == 15
    for a, b in ((one.clean, many.clean), (one.raw, many.raw)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    for by in (None, "department_name"):
        pairs = [sorted(map(str, scenario.run_simulation(x.clean, by=by, ledger=x.ledger).collect())) for x in (one, many)]
        assert pairs[0] == pairs[1]
    assert ids(many.search("three")) == [50, 60] and ids(many.search("fo")) == [80, 120]
    # Versions before are as they were: the first batch has doubles of its own only.
    assert ids(open_clean_layer(spark, path, 1).clean.filter("is_duplicate_review_text")) == []
    with pytest.raises(DatasetError):
        append_reviews(parts[0].drop("rating"), path)
    VersionedTables(spark, path).expire(keep=1)
    assert sorted(map(str, open_clean_layer(spark, path).clean.collect())) == sorted(map(str, many.clean.collect()))


def test_stored_digests_are_not_shuffled(spark, raw, tmp_path):
    _, parts = batches(raw)
    path = str(tmp_path / "layer")
    write_clean_layer(parts[0], path)
    append_reviews(parts[1], path)
    tables = [open_digests(spark, f"{folder}/digests", 4) for folder in open_clean_layer(spark, path).version.parts]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in merge_digests(tables[1], tables[:1]):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_layer_digests_every_text_once(spark, raw, tmp_path, monkeypatch):
    """Digests are stored with the reviews, but are no column of the views."""
    from tallyloom.names import TEXT_KEY
    from tallyloom.operators import duplicates
    from tallyloom.sources import layers

    monkeypatch.setattr(duplicates, "text_key", lambda c: F.unhex(F.sha2(F.lower(c), 256)) if not isinstance(c, str) else pytest.fail(c))
    path = str(tmp_path / "layer")
    version = layers.write_clean_layer(raw({"review_text": "A"}, {"review_text": " a"}, {"review_text": None}, {}), path)
    layer = layers.open_clean_layer(spark, path)
    assert TEXT_KEY in version.table(spark, "reviews").columns
    assert TEXT_KEY not in layer.clean.columns and TEXT_KEY not in layer.raw.columns
    assert [r.row_id for r in layer.clean.filter("is_duplicate_review_text").orderBy("row_id").collect()] == [0, 1]
