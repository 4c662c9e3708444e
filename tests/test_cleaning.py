import pytest
from pyspark.sql import functions as F

from tallyloom.names import DERIVED_COLUMNS
from tallyloom.operators import cleaning, duplicates, quality
from tallyloom.sources.layers import read_clean_layer, write_clean_layer


def column(df, name):
    return [r[name] for r in df.orderBy("row_id").collect()]


def test_rows_are_kept_and_gaps_filled(raw, clean):
    rows = [
        {"title": None, "review_text": None, "division_name": None},
        {"department_name": "Unknown", "class_name": None, "rating": None, "recommended_ind": 2.0, "age": None},
    ]
    found = clean(*rows).orderBy("row_id").collect()
    assert len(found) == 2
    assert (found[0].title, found[0].review_text, found[0].division_name) == (
        "Untitled Review", "No Review Text", "Unknown",
    )
    assert not found[0].has_title and not found[0].has_review_text and found[0].review_length_words == 0
    assert (found[1].sentiment, found[1].recommendation_label, found[1].age_band) == ("Unknown",) * 3
    assert not found[1].valid_rating and not found[1].valid_recommendation
    assert set(DERIVED_COLUMNS) <= set(found[0].asDict())


@pytest.mark.parametrize("partitions", [1, 4, 2000])
def test_duplicates_by_trimmed_lower_text(spark, raw, partitions):
    texts = ["Same text", "same TEXT ", "Unique text", "Another", "b", "b", "b", None, None]
    rows = cleaning.clean_rows(raw(*[{"review_text": t} for t in texts]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    flagged = duplicates.flag_duplicate_review_text(rows)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert column(flagged, "is_duplicate_review_text") == [True, True, False, False, True, True, True, False, False]


def test_genuine_placeholder_text_is_a_duplicate_once_a_text_is_missing(clean):
    alone = clean({"review_text": "no review text"}, {"review_text": "x"})
    assert column(alone, "is_duplicate_review_text") == [False, False]
    beside = clean({"review_text": "no review text"}, {"review_text": None})
    assert column(beside, "is_duplicate_review_text") == [True, False]


def test_distinct_repeated_texts_count_spellings(raw, clean):
    rows = [{"review_text": t} for t in ("Same", "same", "same", "other")]
    summary = quality.data_quality_summary(raw(*rows), clean(*rows)).first()
    assert (summary.duplicate_review_rows, summary.duplicate_review_texts) == (3, 2)


def test_duplicates_use_a_stored_digest(raw):
    from tallyloom.functions.text import text_key
    from tallyloom.names import TEXT_KEY

    table = raw(*[{"review_text": t} for t in ("A", " a", "b", None, "no review text")])
    keyed = table.withColumn(TEXT_KEY, text_key("review_text"))
    flags = column(cleaning.clean_reviews(keyed), "is_duplicate_review_text")
    assert flags == column(cleaning.clean_reviews(table), "is_duplicate_review_text") == [True, True, False, False, True]
    assert TEXT_KEY not in cleaning.clean_reviews(keyed).columns


def test_index_column_goes(raw):
    table = raw({}).withColumn("Unnamed: 0", F.lit(1)).withColumn("_c0", F.lit(1))
    assert not {"Unnamed: 0", "_c0"} & set(cleaning.clean_reviews(table).columns)
    assert cleaning.drop_index_column(raw({})).columns == raw({}).columns


def test_audit_has_13_steps_in_order(raw):
    table = raw({"title": None, "review_text": None, "class_name": None}, {"rating": 7.0}, {"review_text": "text 1"})
    _, audit = cleaning.clean_dataset(table)
    found = audit.collect()
    assert [r.step for r in found] == list(range(1, 14))
    assert [r.rows_affected for r in found] == [0, 2, 1, 1, 1, 1, 0, 3, 3, 3, 3, 2, 1]
    assert found[12].action == "2 reviews have a text to show"
    indexed, audit = cleaning.clean_dataset(table.withColumn("Unnamed: 0", F.lit(1)))
    assert audit.first().rows_affected == 3


def test_quality_report_mentions_the_index_only_when_there_is_one(raw, clean):
    table, cleaned = raw({"rating": 9.0}), clean({"rating": 9.0})
    report = {r.issue: r for r in quality.data_quality_report(table, cleaned).collect()}
    assert len(report) == 8 and report["Invalid rating"].severity == "High"
    assert report["Invalid recommendation flag"].severity == "None"
    indexed = quality.data_quality_report(table.withColumn("_c0", F.lit(1)), cleaned).collect()
    assert indexed[-1].issue == "Export index column" and indexed[-1].percentage == 100.0


def test_literal_unknown_counts_as_missing(raw, clean):
    row = {"department_name": "Unknown"}
    assert quality.data_quality_summary(raw(row), clean(row)).first().missing_department == 1


def test_analysis_ready(clean):
    table = clean({}, {"review_text": None}, {"rating": 7.0}, {"rating": 4.5}, {"rating": None})
    assert column(cleaning.analysis_ready(table), "row_id") == [0]


def test_profile(raw):
    table = raw({"title": None, "review_text": "y" * 80}, {"title": "b", "review_text": None}, {"title": "b"})
    found = {r.column: r for r in quality.profile_columns(table).collect()}
    assert found["title"][2:] == (2, 1, pytest.approx(100 / 3), 1, "b")
    assert found["review_text"].sample == "y" * 67 + "..."
    assert found["review_text"].unique == 2 and found["age"].dtype == "double"
    assert "row_id" not in found


def test_clean_layer_gives_back_raw_and_clean(spark, raw, tmp_path):
    table = raw(
        {"title": None, "review_text": None, "division_name": None, "age": None},
        {"department_name": "Unknown", "review_text": "No Review Text"},
        {"class_name": None, "review_text": "No Review Text"},
    )
    write_clean_layer(table, str(tmp_path / "layer"))
    raw_again, clean_again = read_clean_layer(spark, str(tmp_path / "layer"))
    order = lambda df: [r.asDict() for r in df.orderBy("row_id").collect()]
    assert order(raw_again.select(*table.columns)) == order(table)
    expected = cleaning.clean_reviews(table)
    assert order(clean_again.select(*expected.columns)) == order(expected)


def test_row_rules_work_on_a_stream(spark, raw, tmp_path):
    raw({"rating": 2.0}, {"rating": 4.5}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw({}).schema).parquet(str(tmp_path / "in"))
    query = (
        cleaning.clean_rows(stream).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert column(spark.read.parquet(str(tmp_path / "out")), "sentiment") == ["Negative", "Positive"]
