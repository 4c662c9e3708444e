"""Load review tables from CSV, workbooks or Parquet, and keep them as a typed Parquet layer."""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.functions.numeric import identifier
from tallyloom.functions.text import text_key
from tallyloom.names import ROW_ID, TEXT_KEY
from tallyloom.sources.coerce import coerce_types, null_missing_tokens, rename_source_columns
from tallyloom.sources.csv_records import read_records, survey
from tallyloom.sources.schema_check import DatasetError
from tallyloom.sources.workbook import read_workbooks

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
FORMATS = {".csv": "csv", ".xlsx": "xlsx", ".parquet": "parquet"}
# Compressions Spark reads by the ending of the name, which has to be in small letters.
COMPRESSIONS = (".gz", ".bz2", ".zst", ".deflate", ".lz4", ".snappy")
DEFAULT_FILE = "Womens Clothing E-Commerce Reviews.csv"


def _extension(name: str) -> str:
    """The ending of a name in small letters, without that of a compression."""
    stem, extension = os.path.splitext(name.rstrip("/"))
    if extension.lower() in COMPRESSIONS:
        if extension not in COMPRESSIONS:
            raise DatasetError(f"'{name}' can't be unpacked; write '{extension.lower()}' in small letters.")
        extension = os.path.splitext(stem)[1]
    return extension.lower()


def format_of(name: str) -> str:
    """The format a name stands for, in any spelling and with or without a compression."""
    extension = _extension(name)
    if extension not in FORMATS:
        raise DatasetError(
            f"Cannot read '{extension or name}' files; known are {', '.join(sorted(FORMATS))}."
        )
    return FORMATS[extension]


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def require_path(spark: SparkSession, path: str) -> None:
    files, target = _hadoop_path(spark, path)
    if not files.exists(target):
        raise DatasetError(f"There is no dataset at {path}.")


def find_default(spark: SparkSession, folder: str) -> str:
    """The file with the usual name, else the first readable one in name order."""
    require_path(spark, folder)
    files, target = _hadoop_path(spark, folder)
    names = sorted(status.getPath().getName() for status in files.listStatus(target))
    usable = [n for n in names if _extension(n) in FORMATS and not n.startswith(("~$", ".", "_"))]
    if DEFAULT_FILE in usable:
        return f"{folder.rstrip('/')}/{DEFAULT_FILE}"
    if not usable:
        raise DatasetError(f"{folder} holds no file of a known format.")
    return f"{folder.rstrip('/')}/{usable[0]}"


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per CSV file: file, header (its first line) and utf8 (whether all of it is).

    One pass over the bytes, in splits; per file one row is left.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id")).alias("place"),
        "value",
    )
    return lines.groupBy("file").agg(
        F.min_by(F.rtrim("value"), "place").alias("header"), F.every(F.is_valid_utf8("value")).alias("utf8")
    )


def _read_csv_as(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    frame = spark.read.options(**CSV_OPTIONS).option("encoding", encoding).csv(paths)
    # A multi-line file is read by one task from start to end, so the low 33 bits of the
    # generated id grow with the place of the record in its file.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return frame.select("*", F.col("_metadata.file_path").alias("_file"), place.alias("_place"))


def _by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of several frames by column name; one that shares no column with the first is refused."""
    first = set(frames[0].columns) - {"_file", "_place"}
    for frame in frames[1:]:
        if not first & set(frame.columns):
            example = frame.select("_file").first()
            raise DatasetError(
                f"{example[0] if example else 'A file'} has none of the columns {', '.join(sorted(first))}."
            )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, numbered: bool = True) -> DataFrame:
    """CSV with quoted line ends, read in splits; every data file below ``path`` is read, whatever its name.

    Files are put together by column name. Files that are not UTF-8 are read as Latin-1, file by
    file, unless an ``encoding`` is named. ``numbered`` adds ``row_id``. Two scans are made here at
    most, the records are read when the result is. Files in other encodings than these two, or with
    bare carriage returns as line ends, can't be cut at line ends and are read by one task each.
    """
    known = {"utf-8": "UTF-8", "utf8": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1"}
    if encoding is None or encoding.lower() in known:
        files = survey(spark, path, encoding and known[encoding.lower()])
        if not files.old_line_ends:
            frame = read_records(spark, path, files, CSV_OPTIONS)
            place = F.shiftleft("_rank", 33).bitwiseOR(F.col("_place"))
            return frame.select("*", *([place.alias(ROW_ID)] if numbered else [])).drop("_rank", "_place")
    return _read_whole_files(spark, path, encoding, numbered)


def _read_whole_files(spark: SparkSession, path: str, encoding: str | None, numbered: bool) -> DataFrame:
    """One task per file, in groups of equal headers.

    If all files are alike, the folder is read as such; else each group's paths are listed, as
    Spark's reader takes them.
    """
    files = csv_files(spark, path)
    latin = F.lit(False) if encoding is not None else ~F.col("utf8")
    # One row per header and encoding, of which there are few.
    groups = files.groupBy("header", latin.alias("latin")).count().orderBy(F.desc("count"), "header", "latin").collect()
    if len(groups) <= 1:
        latin_only = bool(groups) and groups[0]["latin"]
        frame = _read_csv_as(spark, [path], encoding or ("ISO-8859-1" if latin_only else "UTF-8"))
        return _number(frame) if numbered else frame.drop("_file", "_place")
    frames = []
    for group in groups:
        own = files.filter(F.col("header").eqNullSafe(F.lit(group["header"])) & (latin == group["latin"]))
        # Listed paths are URL-encoded, paths to read are not.
        paths = [unquote(r["file"]) for r in own.select("file").orderBy("file").collect()]
        frames.append(_read_csv_as(spark, paths, encoding or ("ISO-8859-1" if group["latin"] else "UTF-8")))
    frame = _by_name(frames)
    return _number(frame) if numbered else frame.drop("_file", "_place")


def _number(df: DataFrame) -> DataFrame:
    """``row_id``: rank of the file by name, then place in the file.

    Names are ranked as a table of one row per file; how it is joined is left to Spark.
    """
    names = df.groupBy(F.col("_file").alias("_name")).agg(F.lit(True).alias("_any"))
    ranks = names.select("_name", (F.row_number().over(Window.orderBy("_name")) - 1).cast("long").alias("_rank"))
    return df.join(ranks, F.col("_file") == F.col("_name"), "left").withColumn(
        ROW_ID, F.shiftleft("_rank", 33).bitwiseOR(F.col("_place"))
    ).drop("_name", "_rank", "_file", "_place")


def read_any(
    spark: SparkSession, path: str, fmt: str | None = None, encoding: str | None = None, numbered: bool = True
) -> DataFrame:
    """Cells as read: text for CSV and workbooks, stored types for Parquet.

    A named format reads every data file below ``path``; else the name of ``path`` tells it.
    """
    require_path(spark, path)
    fmt = fmt or format_of(path)
    if fmt == "csv":
        return read_csv(spark, path, encoding, numbered)
    if fmt == "xlsx":
        rows = read_workbooks(spark, path).withColumnRenamed("_row", "_place")
        return _number(rows) if numbered else rows.drop("_file", "_place")
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise DatasetError(f"Cannot read format '{fmt}'.")


def load_reviews(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    encoding: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """Typed raw review table with a unique ``row_id``.

    ``key`` names a unique integer column to use as the row's identity; Parquet tables without
    a ``row_id`` need it, because their rows have no order of their own. Cells that spell a
    missing value are a matter of text files; Parquet tables keep what they store.
    """
    fmt = fmt or format_of(path)
    frame = read_any(spark, path, fmt, encoding, numbered=key is None)
    if fmt != "parquet":
        frame = null_missing_tokens(frame)
    if key is not None:
        frame = frame.withColumn(ROW_ID, F.col(identifier(key)).cast("bigint"))
    frame = rename_source_columns(frame)
    if ROW_ID not in frame.columns:
        raise DatasetError("Name a unique integer column as the key of this table.")
    return coerce_types(frame)


def load_default_reviews(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    path = find_default(spark, folder)
    return load_reviews(spark, path), os.path.basename(path)


def write_raw_layer(raw: DataFrame, path: str) -> DataFrame:
    """Store the typed raw table as Parquet, with the digest duplicate detection needs.

    Multi-line CSV cannot be split, so it is worth reading once only; this also fixes the
    generated ``row_id`` values.
    """
    raw.withColumn(TEXT_KEY, text_key("review_text")).write.mode("errorifexists").parquet(path)
    return raw.sparkSession.read.parquet(path)
