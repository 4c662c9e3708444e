"""Folders of ``.xlsx`` workbooks: one Spark task reads one workbook at a time.

A sheet holds at most 1,048,576 rows, so a workbook is bounded by its format. Cells come out
as text; typing is left to :mod:`tallyloom.sources.coerce`.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyloom.sources.schema_check import DatasetError

BATCH_ROWS = 10_000
HEADER_SCHEMA = pa.schema([("at", pa.int32()), ("name", pa.string())])


def _batch(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema=schema)


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def _texts(node) -> str:
    """All text below a node, without phonetic hints."""
    if _tag(node) == "rPh":
        return ""
    own = node.text or "" if _tag(node) == "t" else ""
    return own + "".join(_texts(child) for child in node)


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _sheet_paths(book: zipfile.ZipFile) -> list[str]:
    links = {
        link.get("Id"): posixpath.normpath(posixpath.join("/xl", link.get("Target"))).lstrip("/")
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [node for node in root.iter() if _tag(node) == "sheet"]
    ids = [v for s in sheets for k, v in s.attrib.items() if k.rpartition("}")[2] == "id" and "}" in k]
    return [links[i] for i in ids]


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_texts(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]


def _cell(node, shared: list[str]) -> str | None:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return _texts(node)
    value = next((child.text for child in node if _tag(child) == "v"), None)
    return shared[int(value)] if kind == "s" and value is not None else value


def _rows(book: zipfile.ZipFile, sheet: str, shared: list[str]) -> Iterator[dict[int, str]]:
    with book.open(sheet) as stream:
        for _, node in ElementTree.iterparse(stream):
            if _tag(node) == "row":
                cells = {}
                for position, cell in enumerate(n for n in node if _tag(n) == "c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else position
                    cells[at] = _cell(cell, shared)
                yield cells
                node.clear()


def _header(cells: dict[int, str]) -> dict[int, str]:
    return {at: name if name else f"Unnamed: {at}" for at, name in cells.items()}


def _review_sheet(content: bytes) -> tuple[dict[int, str], Iterator[dict[int, str]]]:
    """Header and rows of the first sheet with texts and ratings, else of the first sheet."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = _shared_strings(book)
    chosen = None
    for sheet in _sheet_paths(book):
        rows = _rows(book, sheet, shared)
        header = _header(next(rows, {}))
        if chosen is None or {"Review Text", "Rating"} <= set(header.values()):
            chosen = header, rows
        if {"Review Text", "Rating"} <= set(header.values()):
            break
    if chosen is None:
        raise DatasetError("The workbook has no sheet.")
    return chosen


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks under ``path`` with the union of their columns, as text.

    Every file is taken for one, but for the lock files of open workbooks.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "[!~]*")
        .load(path)
        .select(F.col("_metadata.file_path").alias("path"), "content")
    )

    def headers(batches):
        for batch in batches:
            for content in batch.column("content"):
                names = _review_sheet(content.as_py())[0]
                yield _batch([{"at": at, "name": name} for at, name in names.items()], HEADER_SCHEMA)

    # One row per distinct column name: bounded by the width of the sheets.
    found = files.mapInArrow(headers, "at int, name string").groupBy("name").agg(F.min("at").alias("at"))
    names = [r["name"] for r in found.orderBy("at", "name").collect()]
    if not names:
        raise DatasetError(f"No workbook with a header found in {path}.")

    fields = [*((n, pa.string()) for n in names), ("_file", pa.string()), ("_row", pa.int64())]

    def rows(batches):
        for batch in batches:
            for source, content in zip(batch.column("path"), batch.column("content")):
                header, cells = _review_sheet(content.as_py())
                block: list[dict] = []
                for number, row in enumerate(cells):
                    record = {header[at]: value for at, value in row.items() if at in header}
                    if any(v is not None for v in record.values()):
                        block.append({**record, "_file": source.as_py(), "_row": number})
                    if len(block) == BATCH_ROWS:
                        yield _batch(block, pa.schema(fields))
                        block = []
                yield _batch(block, pa.schema(fields))

    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in names]
        + [T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())]
    )
    return files.mapInArrow(rows, schema)
