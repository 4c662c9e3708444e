"""Every query by name. A query maps the raw and clean review tables to a result."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.text import excerpt
from tallyloom.names import INDEX_COLUMNS, ROW_ID, SOURCE_COLUMNS
from tallyloom.operators import (
    browse,
    cleaning,
    distributions,
    facets,
    filters,
    insights,
    kpis,
    paging,
    quality,
    scenario,
    segments,
    sketches,
    validation,
)
from tallyloom.operators.ledger import Ledger
from tallyloom.plans.settings import CHOICES, EXPECTED, MIN_CLASS, MIN_DEPARTMENT, SAME_NAMES, SWEEP
from tallyloom.sources.coerce import coerce_types
from tallyloom.sources.layers import CleanLayer, append_reviews, open_clean_layer, replace_layer, write_clean_layer
from tallyloom.sources import schema_check
from tallyloom.sources.readers import DEFAULT_FILE, load_default_reviews, load_reviews, read_csv
from tallyloom.sources.schema_check import DatasetError
from tallyloom.sources.sinks import PACKED_ROWS, export
from tallyloom.sources.tables import reviews_from_tables


@dataclass(frozen=True)
class ReviewTables:
    """Raw reviews and what cleaning makes of them; lazy, so a query pays for what it reads."""

    raw: DataFrame
    ledger: Ledger | None = None

    @cached_property
    def clean(self) -> DataFrame:
        return cleaning.clean_reviews(self.raw)

    @cached_property
    def spelled(self) -> DataFrame:
        """The clean table with digests of the texts, taken before the duplicate flag is joined."""
        return cleaning.clean_reviews(self.raw, spellings=True)

    @staticmethod
    def from_folder(spark: SparkSession, folder: str) -> ReviewTables:
        """The tables of a folder as they are now; nothing is kept from an earlier call."""
        return ReviewTables(coerce_types(reviews_from_tables(spark, folder)))

    def stored(self, path: str) -> ReviewTables:
        """Both tables read back from a clean layer written once to ``path``."""
        version = write_clean_layer(self.raw, path)
        return ReviewTables.of(open_clean_layer(self.raw.sparkSession, path, version.number))

    @staticmethod
    def of(layer: CleanLayer) -> ReviewTables:
        tables = ReviewTables(layer.raw, layer.ledger)
        tables.__dict__["clean"] = tables.__dict__["spelled"] = layer.clean
        return tables


Query = Callable[[ReviewTables], DataFrame]
QUERIES: dict[str, Query] = {}
# Queries that write files when they are built, before they run.
WRITES: set[str] = set()


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def writing(function: Query) -> Query:
    WRITES.add(function.__name__)
    return query(function)


def result_only(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda t: function(t.clean)



@query
def clean_reviews(t):
    return t.clean.drop("title", "review_text")


@query
def clean_texts(t):
    return t.clean.select(
        ROW_ID, F.md5("title").alias("title_md5"), F.md5("review_text").alias("text_md5"),
        "review_length_words", "title_length_words", "has_review_text", "has_title",
    )


@query
def duplicate_review_flags(t):
    return t.clean.filter("is_duplicate_review_text").select(ROW_ID, "department_name")


@query
def displayable_reviews(t):
    return cleaning.analysis_ready(t.clean).select(ROW_ID, "rating", "sentiment")


@query
def cleaning_audit(t):
    return cleaning.cleaning_audit(t.raw, t.clean).select("step", "name", "rows_affected")


@query
def filtered_reviews_multi(t):
    return filters.apply_filters(t.clean, **CHOICES).select(ROW_ID, "rating", "class_name")


@query
def filtered_text_availability(t):
    rows = filters.apply_filters(t.clean, has_review_text=filters.WITHOUT_TEXT)
    return rows.select(ROW_ID, "title", "sentiment")


@query
def filtered_reviews_text(t):
    rows = filters.apply_filters(
        t.clean, departments=["BUILDING", "MACHINERY"], classes=["NATION_1", "NATION_7", "NATION_12"],
        has_review_text=filters.WITH_TEXT, keyword="the",
    )
    return rows.select(ROW_ID, "department_name", "class_name")


@query
def review_excerpts(t):
    return t.clean.select(ROW_ID, F.md5(excerpt("review_text")).alias("excerpt_md5"))


@query
def index_column_dropped(t):
    """A table with an export index: cleaning takes the column away and keeps the rest."""
    with_index = t.raw.select(F.col(ROW_ID).alias(INDEX_COLUMNS[0]), ROW_ID, "rating", "class_name")
    return cleaning.drop_index_column(with_index)


@query
def keyword_search(t):
    rows = filters.search_reviews(t.clean.filter("has_review_text"), " Blue ")
    return rows.select(ROW_ID, "title", "rating")


@query
def helpful_negative_filter(t):
    rows = filters.min_helpful_votes(filters.negative_only(t.clean), 5)
    return rows.select(ROW_ID, "positive_feedback_count", "sentiment")


@query
def facet_values(t):
    return facets.facet_values(t.clean, ["ASIA", "EUROPE"], ["BUILDING", "MACHINERY"]).select("facet", "value")


@query
def kept_selections(t):
    offered = facets.facet_values(t.clean, ["ASIA"])
    return facets.keep_offered(offered, {"class": ["NATION_1", "NATION_7", "NATION_99"], "rating": [1, 9]})


@query
def scope_size(t):
    return filters.scope_size(t.clean, **CHOICES)


@query
def scope_categories(t):
    return facets.available_categories(t.clean, "By Product Class")


@query
def scope_reviews(t):
    chosen = filters.resolve_scope(t.clean, "By Department", ["BUILDING", "Unknown"])
    return chosen.select(ROW_ID, "department_name")


QUERIES["kpis"] = result_only(kpis.compute_kpis)


@query
def kpis_filtered(t):
    return kpis.compute_kpis(filters.apply_filters(t.clean, **CHOICES))


@query
def kpis_empty(t):
    return kpis.compute_kpis(filters.apply_filters(t.clean, divisions=["ATLANTIS"]))


QUERIES["largest_vote_count"] = result_only(kpis.largest_vote_count)
QUERIES["domain_validity"] = result_only(kpis.domain_validity)
QUERIES["sentiment_distribution"] = result_only(distributions.sentiment_distribution)
QUERIES["rating_distribution"] = result_only(distributions.rating_distribution)
QUERIES["recommendation_distribution"] = result_only(distributions.recommendation_distribution)
QUERIES["recommendation_by_sentiment"] = result_only(distributions.recommendation_by_sentiment)
QUERIES["recommendation_stack"] = result_only(distributions.recommendation_stack)
QUERIES["age_distribution"] = result_only(distributions.age_distribution)
QUERIES["age_histogram"] = result_only(distributions.age_histogram)
QUERIES["review_length_box"] = result_only(distributions.review_length_box)
QUERIES["helpful_by_sentiment"] = result_only(distributions.helpful_votes_by_sentiment)
QUERIES["segment_division"] = result_only(segments.division_performance)
QUERIES["segment_age_band"] = result_only(segments.age_band_performance)
QUERIES["segments_all"] = result_only(segments.all_segments)
QUERIES["top_classes"] = result_only(segments.top_classes_by_volume)
QUERIES["helpful_by_class"] = result_only(segments.helpful_votes_by_class)
QUERIES["advocacy_vs_criticism"] = result_only(segments.advocacy_vs_criticism)
QUERIES["department_vs_baseline"] = result_only(segments.department_vs_baseline)


@query
def numeric_summary(t):
    return distributions.numeric_summary(t.clean).withColumn("std_dev", F.round("std_dev", 6))


@query
def segment_department(t):
    return segments.department_performance(t.clean, MIN_DEPARTMENT)


@query
def segment_product(t):
    return segments.segment_performance(t.clean, "clothing_id")


@query
def segment_class(t):
    return segments.segment_performance(t.clean, "class_name", MIN_CLASS)


@query
def segment_overview(t):
    return segments.segment_overview(t.clean, "division_name").select(
        "division_name", "reviews", "recommendation_rate", "negative_rate", "rating_on_100"
    )


@query
def worst_classes(t):
    return segments.worst_classes(t.clean, MIN_CLASS)


@query
def class_performance_matrix(t):
    return segments.class_performance_matrix(t.clean, MIN_CLASS, cell_bands=True)


@query
def quality_summary(t):
    return quality.data_quality_summary(t.raw, t.spelled).drop("source_columns", "total_columns")


@query
def missing_by_field(t):
    return quality.missing_values_by_field(t.raw)


@query
def column_completeness(t):
    return quality.column_completeness(t.raw)


@query
def completeness_metrics(t):
    return quality.completeness_metrics(t.raw)


@query
def quality_report(t):
    return quality.data_quality_report(t.raw, t.spelled).drop("impact", "treatment")


@query
def column_profile(t):
    return quality.profile_columns(t.raw)


@query
def validation_table(t):
    return validation.validation_table(t.clean, EXPECTED)


@query
def validation_summary(t):
    summary = validation.validation_summary(t.clean, EXPECTED)
    return summary.withColumn("failed_metrics", F.array_join("failed_metrics", "; "))


@query
def most_helpful_reviews(t):
    return browse.most_helpful_reviews(t.clean, 25)


@query
def most_helpful_negative(t):
    return browse.most_helpful_reviews(t.clean, 25, negative_only=True)


@query
def review_page(t):
    matches = browse.matching_reviews(t.clean, "the", min_votes=2)
    return browse.review_page(matches, page=3, size=25, sort="Age (young to old)")


@query
def review_page_after(t):
    last = {ROW_ID: 5000, "rating": 2.0}
    matches = browse.matching_reviews(t.clean, negative_only=True)
    return browse.review_page_after(matches, last, 25, "Rating (high to low)")


@query
def review_pages_sorted(t):
    """The third page in each of the six orders, through indexes of the list, which is stored once for all of them.

    It is stored, and the indexes are made, when the query is built.
    """
    folder = shared_folder(t.raw.sparkSession, "list-")
    matches = paging.store_list(browse.matching_reviews(t.clean, min_votes=2), f"{folder}/list")
    return reduce(DataFrame.unionByName, [
        paging.build_page_index(matches, sort).page(matches, 3).select(F.lit(sort).alias("sort"), "position", ROW_ID)
        for sort in browse.SORTS
    ])


@query
def review_page_deep(t):
    """The last full page of all reviews with a text, by rating."""
    matches = browse.matching_reviews(t.clean)
    index = paging.build_page_index(matches, "Rating (high to low)")
    return index.page(matches, max(1, index.matches // 25)).select("position", ROW_ID)


@query
def page_summary(t):
    return browse.page_summary(browse.matching_reviews(t.clean, "the", min_votes=2), page=3)


@query
def scenario_overall(t):
    return scenario.run_simulation(t.clean, SWEEP, ledger=t.ledger)


@query
def scenario_scoped(t):
    scoped = filters.resolve_scope(t.clean, "By Division", ["ASIA", "EUROPE"])
    ledger = t.ledger and t.ledger.scoped("division_name", ["ASIA", "EUROPE"])
    return scenario.finite_kpis(scenario.run_simulation(scoped, ledger=ledger))


@query
def scenario_by_class(t):
    return scenario.run_simulation(t.clean, SWEEP, by="class_name", ledger=t.ledger)


@query
def scenario_by_product(t):
    """Products without an id are a segment too."""
    return scenario.run_simulation(t.clean, SWEEP[1:2], by="clothing_id", ledger=t.ledger)


@query
def scenario_same_names(t):
    """Scenarios of one name stay apart; rows are told apart by their figures."""
    return scenario.run_simulation(t.clean, SAME_NAMES, ledger=t.ledger)


@query
def scenario_department(t):
    return scenario.department_simulation(t.clean, SWEEP, MIN_DEPARTMENT, ledger=t.ledger)


@query
def scenario_impact(t):
    return scenario.department_impact(t.clean, ledger=t.ledger)


@query
def scenario_sentiment_comparison(t):
    return scenario.sentiment_comparison(scenario.run_simulation(t.clean, ledger=t.ledger))


@query
def scenario_kpi_change(t):
    return scenario.kpi_change(scenario.run_simulation(t.clean, ledger=t.ledger))


@query
def scenario_movement(t):
    return scenario.movement_steps(scenario.run_simulation(t.clean, ledger=t.ledger))


@query
def insights_executive(t):
    return insights.executive_insights(t.clean, MIN_DEPARTMENT).drop("narrative")


@query
def insights_empty(t):
    nothing = filters.apply_filters(t.clean, divisions=["ATLANTIS"])
    return insights.executive_insights(nothing, MIN_DEPARTMENT).drop("narrative")


@query
def insights_product(t):
    return insights.product_insights(t.clean, MIN_CLASS).drop("narrative")


@query
def insights_customer(t):
    return insights.customer_insights(t.clean).drop("narrative")


@query
def insights_scenario(t):
    result = scenario.run_simulation(t.clean, ledger=t.ledger)
    departments = scenario.department_simulation(t.clean, ledger=t.ledger)
    return insights.scenario_insights(result, departments).drop("narrative")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder name below the cluster's checkpoint folder; a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{prefix}{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise DatasetError("Set spark.checkpoint.dir to a folder all executors can reach.")
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@writing
def csv_mixed_files(t):
    """Write CSV files of different column order, one set of them in Latin-1, and load all of them.

    The files are written when the query is built, before it runs.
    """
    folder = f"{shared_folder(t.raw.sparkSession, 'mixed-')}/csv"
    headers = {name: header for header, name in SOURCE_COLUMNS.items()}
    rows = t.raw.select(F.col(ROW_ID).alias("Key"), "clothing_id", "rating", "class_name").withColumnsRenamed(headers)
    part = F.pmod("Key", F.lit(3))
    sets = ((0, rows.columns, "UTF-8"), (1, rows.columns[::-1], "UTF-8"), (2, rows.columns, "ISO-8859-1"))
    for number, columns, encoding in sets:
        one = rows.filter(part == number).withColumn("Title", F.lit("café") if number else F.lit("plain"))
        one.select(*columns, "Title").write.mode("append").csv(folder, header=True, encoding=encoding)
    loaded = load_reviews(t.raw.sparkSession, folder, "csv", key="Key")
    return loaded.select(ROW_ID, "clothing_id", "rating", "class_name", "title")


@writing
def csv_quoted_records(t):
    """Write cells full of quotes, delimiters and line ends as CSV, and load them: plain files in splits, compressed ones whole.

    Every fourth review goes to the plain files. They are written when the query is built, before it runs.
    """
    spark = t.raw.sparkSession
    folder = f"{shared_folder(spark, 'quoted-')}/csv"
    text = F.concat(
        F.lit('"'), F.coalesce("title", F.lit("")), F.lit(',"\n\n"",'), F.coalesce("review_text", F.lit("none")), F.lit("\n,")
    )
    rows = t.raw.select(F.col(ROW_ID).alias("Key"), "rating", text.alias("body"))
    packed = {"compression": "gzip", "maxRecordsPerFile": PACKED_ROWS}
    for chosen, options in ((F.pmod("Key", F.lit(4)) == 0, {}), (F.pmod("Key", F.lit(4)) != 0, packed)):
        rows.filter(chosen).write.mode("append").options(**options).csv(folder, header=True, escape='"', encoding="UTF-8")
    loaded = read_csv(spark, folder, numbered=False)
    return loaded.select(
        F.col("Key").cast("long").alias(ROW_ID), F.col("rating").cast("double").alias("rating"), F.md5("body").alias("text_md5")
    )


@writing
def csv_round_trip(t):
    """Write the raw reviews as compressed CSV, load them again, and clean what came back.

    The files are written when the query is built, before it runs.
    """
    spark = t.raw.sparkSession
    folder = f"{shared_folder(spark, 'reviews-')}/csv"
    headers = {name: header for header, name in SOURCE_COLUMNS.items()}
    export(t.raw.withColumnsRenamed(headers).withColumnRenamed(ROW_ID, "Key"), folder, compression="gzip")
    loaded = load_reviews(spark, folder, "csv", encoding="UTF-8", key="Key")
    return cleaning.clean_rows(loaded).select(
        ROW_ID, "rating", "sentiment", "age_band", "has_review_text", "review_length_words",
        "department_name", F.md5("review_text").alias("text_md5"),
    )


@writing
def default_file(t):
    """Load the usual file of a folder that holds another one, too."""
    spark = t.raw.sparkSession
    folder = shared_folder(spark, "exports-")
    headers = {name: header for header, name in SOURCE_COLUMNS.items()}
    rows = t.raw.select(F.col(ROW_ID).alias("Key"), "rating", "department_name").withColumnsRenamed(headers)
    rows.filter("Key % 2 = 0").write.csv(f"{folder}/a.csv", header=True)
    rows.write.csv(f"{folder}/{DEFAULT_FILE}", header=True)
    loaded, name = load_default_reviews(spark, folder)
    return loaded.select(F.col("Key").cast("long").alias("key"), "rating", "department_name", F.lit(name).alias("source"))


@writing
def layer_replaced(t):
    """A layer of half the reviews; a candidate without ratings, which is refused; then all reviews.

    Reviews per version and department, read from versions one and two.
    """
    spark = t.raw.sparkSession
    path = f"{shared_folder(spark, 'versions-')}/clean"
    first = write_clean_layer(t.raw.filter(F.col(ROW_ID) % 2 == 0), path)
    refused, _ = replace_layer(t.raw.drop("rating"), path)
    second, _ = replace_layer(t.raw, path)
    counts = [
        open_clean_layer(spark, path, number).clean.groupBy("department_name").agg(
            F.lit(number).cast("long").alias("version"), F.lit(refused.number).cast("long").alias("after_refusal"),
            F.count(F.lit(1)).alias("reviews"), F.count_if("is_duplicate_review_text").alias("repeated"),
        )
        for number in (first.number, second.number)
    ]
    return counts[0].unionByName(counts[1])


@query
def property_sheet(t):
    """Sheets of the raw table, and of one with a column too few and one too many."""
    other = t.raw.drop("age").withColumn("store", F.lit(1))
    sheets = [schema_check.property_sheet(df, name) for df, name in ((t.raw, "reviews"), (other, "other"))]
    return sheets[0].withColumn("sheet", F.lit("reviews")).unionByName(sheets[1].withColumn("sheet", F.lit("other")))


@writing
def keyword_search_indexed(t):
    """Two terms looked up in the index of a layer, then searched for in the files that can hold them."""
    spark = t.raw.sparkSession
    path = f"{shared_folder(spark, 'search-')}/clean"
    write_clean_layer(t.raw, path, cluster_by=[ROW_ID], search_index=True, file_rows=2_000)
    layer = open_clean_layer(spark, path)
    return reduce(DataFrame.unionByName, [
        layer.search(term).filter("has_review_text").select(F.lit(term).alias("term"), ROW_ID, "title", "rating")
        for term in (" Blue ", "#1203")
    ])


@writing
def layer_appended(t):
    """A layer of two thirds of the reviews and an appended third: repeated texts among all of them."""
    spark = t.raw.sparkSession
    path = f"{shared_folder(spark, 'appended-')}/clean"
    third = F.pmod(F.col(ROW_ID), F.lit(3)) == 1
    write_clean_layer(t.raw.filter(~third), path)
    version = append_reviews(t.raw.filter(third), path)
    clean = open_clean_layer(spark, path, version.number).clean
    return clean.filter("is_duplicate_review_text").select(ROW_ID, "department_name", "sentiment")


@writing
def stored_sketches(t):
    """Medians and distinct products of departments from the sketches of a layer in two parts, held against the reviews.

    ``within`` tells whether the estimate keeps to its bound; for distinct counts, four standard errors.
    """
    spark = t.raw.sparkSession
    path = f"{shared_folder(spark, 'sketches-')}/clean"
    half = F.col(ROW_ID) % 2 == 0
    write_clean_layer(t.raw.filter(half), path, sketches=True)
    append_reviews(t.raw.filter(~half), path)
    layer = open_clean_layer(spark, path)
    by = "department_name"
    medians = sketches.estimated_quantiles(layer.sketches, (0.5,), by)
    cells = layer.clean.select(F.col(by).alias("department"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("name"), value(m).cast("double").alias("x")) for m, value in sketches.MEASURES.items()
    ])))
    held = cells.join(F.broadcast(medians), (F.col("department") == F.col("segment")) & (F.col("name") == F.col("measure")))
    e = sketches.RANK_ERROR
    kept = held.groupBy("department", "measure", "n").agg(
        F.expr(f"count_if(x < q1) <= n * {0.5 + e!r}D AND count_if(x <= q1) >= n * {0.5 - e!r}D").alias("within")
    )
    products = sketches.estimated_distinct(layer.sketches, by=by)
    exact = layer.clean.groupBy(F.col(by).alias("department")).agg(F.count_distinct("clothing_id").alias("n"))
    close = F.abs(F.col("distinct_values") - F.col("n")) <= F.greatest(F.lit(1.0), 4 * sketches.DISTINCT_ERROR * F.col("n"))
    counted = exact.join(products, F.col("department") == F.col("segment")).select("department", F.lit("products").alias("measure"), "n", close.alias("within"))
    return kept.unionByName(counted)
