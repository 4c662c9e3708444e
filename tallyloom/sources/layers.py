"""The clean layer: clean once, store as Parquet, and let every view prune its columns.

One stored table serves both sides. It has the columns of the clean table plus a marker per
taxonomy column that was filled, so that the raw table is a projection of it and no text is
stored twice, and the digest of each text, from which repeated texts are found. The ids of reviews with a repeated text are a narrow table beside it, joined only by
views that use the flag: texts are written where they are read. A ledger of sums by ranges of ids
serves scenarios. All of them are committed together as a version of the layer, with the figures
observed while they were written; readers stay with the version they opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallyloom.functions.numeric import identifier
from tallyloom.functions.text import text_key
from tallyloom.names import DERIVED_COLUMNS, TAXONOMY_COLUMNS, TEXT_KEY
from tallyloom.operators.cleaning import clean_rows
from tallyloom.operators.duplicates import add_flag, digest_counts, repeated_review_rows
from tallyloom.operators.filters import needle, search_reviews
from tallyloom.operators.ledger import Ledger, build_ledger
from tallyloom.operators.sketches import build_sketches
from tallyloom.sources.digests import merge_digests, open_digests, write_digests
from tallyloom.sources.schema_check import DatasetError, SchemaReport, describe_schema
from tallyloom.sources.search_index import SearchIndex, write_search_index
from tallyloom.sources.versions import Version, VersionedTables

MARKER = "was_missing_"
# Texts are nearly all of a layer's bytes: they take two thirds of what Spark's default codec makes of them.
CODEC = "zstd"
# Shuffle files of the reviews go as soon as these are written, not when the driver collects its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Rows that are joined to their texts late are narrow when they are shuffled: tasks of the usual size would sort some
# GB of texts each, on disk.
SORTING = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
}


@dataclass(frozen=True)
class CleanLayer:
    """Tables of one version of a layer."""

    version: Version
    raw: DataFrame
    clean: DataFrame
    ledger: Ledger
    #: One index per part, if the layer is indexed.
    indexes: tuple[SearchIndex, ...] = ()

    @property
    def sketches(self) -> DataFrame:
        """Sketches of all parts; cells of several parts come several times, and merge."""
        return self.version.table(self.raw.sparkSession, "sketches")

    def search(self, term: str) -> DataFrame:
        """The clean reviews that mention a term, read from those files only that can hold it."""
        literal = needle(term)
        found = [index.files(literal) for index in self.indexes] if literal else []
        if not found or None in found:
            return search_reviews(self.clean, term)
        files = [f for part in found for f in part]
        if not files:
            return self.clean.filter(F.lit(False))
        spark = self.raw.sparkSession
        stored = spark.read.schema(self.version.table(spark, "reviews").schema).parquet(*files)
        return search_reviews(_views(self.version, stored)[1], term)


def write_clean_layer(
    raw: DataFrame, path: str, cluster_by: list[str] | None = None, search_index: bool = False, file_rows: int = 0,
    sketches: bool = False,
) -> Version:
    """Clean ``raw`` and commit it as the next version of a layer (on a cluster, in a shared folder).

    ``cluster_by`` names columns by which each task sorts its rows, so that filters on them skip
    row groups; rows stay in their task. ``search_index`` adds an index of the texts, which tells
    files apart; ``file_rows`` bounds the reviews of a file; ``sketches`` adds a table of mergeable
    sketches for estimated quantiles and distinct counts. Earlier versions stay as they are.
    """
    buckets = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _write_version(raw, path, cluster_by, {
        "search_index": search_index, "file_rows": file_rows, "sketches": sketches, "buckets": buckets
    }, None)


def append_reviews(raw: DataFrame, path: str, cluster_by: list[str] | None = None) -> Version:
    """Commit a version with further reviews, whose ids must be new, besides those of the latest one.

    Stored reviews stay where they are. Repeated texts are found by digest: those of the new
    reviews are joined with the stored ones bucket by bucket, and earlier reviews that get their
    first double are flagged in the new version only. The ledger is made anew from narrow columns.
    """
    report = describe_schema(raw)
    if not report.is_usable:
        raise DatasetError(f"Required columns not found: {', '.join(report.missing_required)}.")
    latest = VersionedTables(raw.sparkSession, path).version()
    return _write_version(raw, path, cluster_by, {k: latest.notes[k] for k in ("search_index", "file_rows", "sketches", "buckets")}, latest)


@contextmanager
def _settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _write_version(raw: DataFrame, path: str, cluster_by: list[str] | None, choices: dict, latest: Version | None) -> Version:
    """Write a part with all tables, and commit it, behind the parts of an earlier version if there is one."""
    spark = raw.sparkSession
    layer = VersionedTables(spark, path)
    folder = layer.new_folder()
    earlier = latest.parts if latest else []
    markers = {
        f"{MARKER}{c}": F.col(c).isNull() for c in TAXONOMY_COLUMNS if c in raw.columns
    }
    rows = clean_rows(raw.withColumns(markers))
    if TEXT_KEY not in rows.columns:
        rows = rows.withColumn(TEXT_KEY, F.when(F.col("has_review_text"), text_key("review_text")))
    if cluster_by:
        rows = rows.sortWithinPartitions(*[F.col(identifier(c)) for c in cluster_by])
    seen = Observation()
    writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("maxRecordsPerFile", choices["file_rows"])
    with _settings(spark, TIDY | (SORTING if cluster_by else {})):
        writer.option("compression", CODEC).parquet(f"{folder}/reviews")
    # The rest comes from what is stored, so that nothing is cleaned or digested twice.
    cleaned = spark.read.parquet(f"{folder}/reviews")
    buckets = choices["buckets"]
    write_digests(digest_counts(cleaned), f"{folder}/digests", buckets)
    counts = open_digests(spark, f"{folder}/digests", buckets)
    if earlier:
        counts, doubled = merge_digests(counts, [open_digests(spark, f"{part}/digests", buckets) for part in earlier])
        repeated = repeated_review_rows(cleaned, counts).select("_row").union(doubled)
    else:
        repeated = repeated_review_rows(cleaned, counts).select("_row")
    repeated.write.parquet(f"{folder}/repeated")
    stored = [f"{part}/reviews" for part in (*earlier, folder)]
    ledger = build_ledger(spark.read.option("mergeSchema", len(stored) > 1).parquet(*stored))
    ledger.table.write.parquet(f"{folder}/ledger")
    if choices["search_index"]:
        write_search_index(spark, f"{folder}/reviews", f"{folder}/search")
    tables = ["reviews", "repeated", "digests", "ledger"]
    if choices["sketches"]:
        build_sketches(spark.read.parquet(f"{folder}/reviews")).write.parquet(f"{folder}/sketches")
        tables.append("sketches")
    return layer.commit(folder, {
        **choices, "tables": tables, "earlier": [part.rsplit("/", 1)[1] for part in earlier],
        "rows": seen.get["rows"] + (latest.notes["rows"] if latest else 0), "cuts": list(ledger.cuts), "ways": ledger.ways,
    })


def _views(version: Version, layer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The raw and the clean table of stored reviews, all of a version's or some of its files."""
    # The ids are unique as written; grouping them says so, and lets Spark leave the join out.
    repeated = version.table(layer.sparkSession, "repeated").groupBy("_row").agg(F.lit(True).alias("_flag"))
    source = [c for c in layer.columns if c != TEXT_KEY and not c.startswith(MARKER)]
    present = {"title": "has_title", "review_text": "has_review_text"}
    present |= {c: f"NOT {MARKER}{c}" for c in TAXONOMY_COLUMNS if c in source}
    raw = layer.selectExpr(
        *[
            f"CASE WHEN {present[c]} THEN {c} END AS {c}" if c in present else f"`{c}`"
            for c in source
            if c not in DERIVED_COLUMNS
        ]
    )
    return raw, add_flag(layer.select(*[identifier(c) for c in source]), repeated)


def open_clean_layer(spark: SparkSession, path: str, number: int | None = None) -> CleanLayer:
    """A version of a stored layer, the latest one by default."""
    version = VersionedTables(spark, path).version(number)
    raw, clean = _views(version, version.table(spark, "reviews"))
    ledger = Ledger(version.table(spark, "ledger", own=True), tuple(version.notes["cuts"]), version.notes["ways"])
    indexed = version.parts if version.notes["search_index"] else []
    indexes = tuple(SearchIndex(spark, f"{part}/search", f"{part}/reviews") for part in indexed)
    return CleanLayer(version, raw, clean, ledger, indexes)


def read_clean_layer(spark: SparkSession, path: str, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The raw and the clean table of a stored layer."""
    layer = open_clean_layer(spark, path, number)
    return layer.raw, layer.clean


def replace_layer(candidate: DataFrame, path: str, cluster_by: list[str] | None = None) -> tuple[Version, SchemaReport]:
    """Make a typed raw table the layer's next version if it has all required columns, else leave the layer.

    Readers see the old version until the new one is complete. The report says what is missing.
    """
    report = describe_schema(candidate)
    if not report.is_usable:
        return VersionedTables(candidate.sparkSession, path).version(), report
    return write_clean_layer(candidate, path, cluster_by), report
