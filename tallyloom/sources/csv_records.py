"""CSV files as records, read in splits although quoted cells may hold line ends.

A line belongs to the split it starts in, but whether it starts a record or goes on inside a quoted
cell depends on all lines before it. What a line, and so a split, does to that state is a function
of two values: where it ends if it starts outside quotes, and where if it starts inside. One scan
finds this function for every split, with the number of records starting in it under either
assumption; combined from the start of each file on, they tell the true state and record number at
every split. A second scan cuts the lines of each split into records. Records that cross a split
come from a third scan, if there are any, which returns nothing but their pieces.

Per split the driver keeps a state and a number, no more than Spark's own list of splits. Splits
have to be the same in all scans: the setting they hang on is pinned, and a scan that meets other
splits than the first fails instead of guessing.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.sources.schema_check import DatasetError

DELIMITER, QUOTE = b",", b'"'
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
# Where a cell can be: at its start, unquoted, quoted, or behind a quote in a quoted one.
START, PLAIN, QUOTED, ENDED = range(4)
AFTER_QUOTE = {START: QUOTED, PLAIN: PLAIN, QUOTED: ENDED, ENDED: QUOTED}


@dataclass(frozen=True)
class Split:
    """Start state, number of the first record, and what is known of the file."""

    inside: bool
    number: int
    rank: int
    latin: bool
    group: int


@dataclass(frozen=True)
class CsvFiles:
    """What the first scan finds: splits by file and start, headers by group, and paths in name order."""

    splits: dict[tuple[int, int], Split]
    headers: list[list[str]]
    paths: list[str]
    #: Whether a split, or a file, ends inside quotes.
    crossed: bool
    #: Whether lines end with a carriage return only, which splits are not cut at.
    old_line_ends: bool


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the end of a line is inside quotes, given whether its start is.

    A quote opens a cell only at the cell's start and is doubled inside; one behind which the cell
    goes on makes the rest of the cell unquoted, as in Spark's parser.
    """
    state = QUOTED if inside else START
    for i, text in enumerate(line.split(QUOTE)):
        if i:
            state = AFTER_QUOTE[state]
        if text and state != QUOTED:
            state = START if text.endswith(DELIMITER) else PLAIN
    return state == QUOTED


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), start of the split, and bytes of every line, in order within a split."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Its default is the number of cores, which changes as executors come and go.
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """Lines of one split each, with its key; a split may come in several parts, one after the other."""
    for batch in batches:
        file, start = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield (int(file[a]), int(start[a])), batch.column(2).slice(a, b - a)


class _Part:
    """Some lines of a split: which are blank, and which have quotes."""

    def __init__(self, lines: pa.Array, first_of_file: bool):
        if first_of_file and (head := lines[0].as_py()).startswith(BYTE_ORDER_MARK):
            lines = pa.concat_arrays([pa.array([head[len(BYTE_ORDER_MARK) :]], lines.type), lines.slice(1)])
        self.lines = lines
        length = pc.binary_length(lines).to_numpy(zero_copy_only=False)
        blank = length == 0
        short = np.flatnonzero(length == 1)
        if len(short):
            blank[short] = [x == b"\r" for x in lines.take(pa.array(short)).to_pylist()]
        self.filled = ~blank
        self.quoted = np.flatnonzero(pc.match_substring(lines, QUOTE.decode()).to_numpy(zero_copy_only=False))

    def inside(self, state: bool) -> tuple[np.ndarray, bool]:
        """Whether each line starts inside quotes, and whether the last ends there."""
        out = np.empty(len(self.lines), dtype=bool)
        done = 0
        for i, line in zip(self.quoted.tolist(), self.lines.take(pa.array(self.quoted)).to_pylist()):
            out[done : i + 1] = state
            state, done = ends_inside(line, state), i + 1
        out[done:] = state
        return out, state


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: end state and number of records for both start states, validity as UTF-8, first record."""
    schema = pa.schema([
        ("file", pa.int64()), ("start", pa.int64()), ("utf8", pa.bool_()), ("header", pa.binary()),
        ("ends", pa.list_(pa.bool_())), ("records", pa.list_(pa.int64())),
    ])
    key, found = None, None

    def row():
        return pa.RecordBatch.from_pylist([found], schema=schema)

    for own, lines in _runs(batches):
        if own != key:
            if found:
                yield row()
            key = own
            found = {"file": key[0], "start": key[1], "utf8": True, "header": None, "ends": [False, True], "records": [0, 0]}
            header, heading = [], key[1] == 0
            first = key[1] == 0
        part = _Part(lines, first)
        first = False
        try:
            lines.cast(pa.string())
        except pa.ArrowInvalid:
            found["utf8"] = False
        for assumed in (0, 1):
            inside, found["ends"][assumed] = part.inside(found["ends"][assumed])
            found["records"][assumed] += int((part.filled & ~inside).sum())
            if heading and not assumed:
                for i in range(len(lines)):
                    if header or part.filled[i]:
                        if header and not inside[i]:
                            heading = False
                            break
                        header.append(part.lines[i].as_py())
                found["header"] = b"\n".join(header)
    if found:
        yield row()


def survey(spark: SparkSession, path: str, encoding: str | None = None) -> CsvFiles:
    """Scan all files below a path once. Files that are not UTF-8 count as Latin-1, unless an encoding is named."""
    lines = _lines(spark, path)
    schema = "file long, start long, utf8 boolean, header binary, ends array<boolean>, records array<long>"
    # One row per split.
    rows = sorted(lines.mapInArrow(_survey, schema).collect(), key=lambda r: (r["file"], r["start"]))
    # The list of files spells an empty host, the metadata of rows doesn't.
    known = [(re.sub("^(\\w+):///", r"\1:/", p),) for p in lines.inputFiles()]
    named = spark.createDataFrame(known, "path string").select("path", F.xxhash64("path").alias("file"))
    paths = {r["file"]: r["path"] for r in named.collect()}
    files = sorted({r["file"] for r in rows}, key=lambda f: paths[f])
    rank = {f: i for i, f in enumerate(files)}
    bad = {r["file"] for r in rows if not r["utf8"]}
    latin = {f: encoding == "ISO-8859-1" if encoding else f in bad for f in files}
    headers = {
        r["file"]: bytes(r["header"]).decode("latin-1" if latin[r["file"]] else "utf-8", "replace").rstrip()
        for r in rows if r["header"] is not None
    }
    # The header most files have comes first; there are few different ones.
    counts: dict[str, int] = {}
    for header in headers.values():
        counts[header] = counts.get(header, 0) + 1
    order = sorted(counts, key=lambda h: (-counts[h], h))
    splits: dict[tuple[int, int], Split] = {}
    state = Split(False, 0, 0, False, 0)
    last, crossed = None, False
    for r in rows:
        file = r["file"]
        if file != last:
            state = Split(False, 0, rank[file], latin[file], order.index(headers.get(file, order[0])))
            last = file
        splits[(file, r["start"])] = state
        at = int(state.inside)
        state = replace(state, inside=r["ends"][at], number=state.number + r["records"][at])
        crossed |= state.inside
    return CsvFiles(splits, [_names(h) for h in order], [paths[f] for f in files], crossed, any("\r" in h for h in order))


def _names(header: str) -> list[str]:
    """Column names as Spark's reader makes them: a place for an empty name, one behind a repeated name."""
    cells = next(csv.reader(io.StringIO(header, newline="")), [])
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _cutter(splits: dict[tuple[int, int], Split], pieces: bool):
    """The function of a scan that gives whole records, or else the pieces of those that cross splits."""
    schema = pa.schema([
        ("rank", pa.int64()), ("latin", pa.bool_()), ("part", pa.int32()), ("start", pa.int64()),
        ("tail", pa.int32()), ("number", pa.int64()), ("record", pa.binary()),
    ])

    def rows(split: Split, start: int, numbers, records: pa.Array, tail: int) -> pa.RecordBatch:
        values = (split.rank, split.latin, split.group, start, tail)
        same = [pa.repeat(pa.scalar(v, f.type), len(records)) for v, f in zip(values, schema)]
        return pa.RecordBatch.from_arrays([*same, pa.array(numbers, pa.int64()), records], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def left():
            """The open record at the end of a split."""
            if key is not None and open_ and pieces:
                yield rows(split, key[1], [number], pa.array([b"\n".join(open_)], pa.binary()), int(own))

        for here, lines in _runs(batches):
            if here != key:
                yield from left()
                key = here
                if key not in splits:
                    raise RuntimeError("The files or their splits have changed since they were first read; read them again.")
                split = splits[key]
                # own: the open record starts in this split. number: that of the last record started.
                state, number, open_, own = split.inside, split.number - 1, [], False
                first = key[1] == 0
            part = _Part(lines, first)
            first = False
            inside, end = part.inside(state)
            starts = part.filled & ~inside
            follows = np.append(inside[1:], end)
            numbers = number + np.cumsum(starts)
            single = np.flatnonzero(starts & ~follows)
            if len(single) and not pieces:
                yield rows(split, key[1], numbers[single], part.lines.take(pa.array(single)), 0)
            several = np.flatnonzero(inside | (starts & follows))
            joined, which = [], []
            for i, line in zip(several.tolist(), part.lines.take(pa.array(several)).to_pylist()):
                if not inside[i]:
                    open_, own = [], True
                open_.append(line)
                if not follows[i]:
                    if own and not pieces:
                        joined.append(b"\n".join(open_))
                        which.append(int(numbers[i]))
                    elif not own and pieces:
                        yield rows(split, key[1], [int(numbers[i])], pa.array([b"\n".join(open_)], pa.binary()), 0)
                    open_, own = [], False
            if joined:
                yield rows(split, key[1], which, pa.array(joined, pa.binary()), 0)
            state, number = end, int(numbers[-1])
        yield from left()

    return run


_RECORDS = "rank long, latin boolean, part int, start long, tail int, number long, record binary"


def records(spark: SparkSession, path: str, files: CsvFiles) -> DataFrame:
    """rank of the file, latin, part (its header's place in the list), number in the file, and bytes of every record.

    Number 0 is the header.
    """
    lines = _lines(spark, path)
    columns = ["rank", "latin", "part", "number", "record"]
    whole = lines.mapInArrow(_cutter(files.splits, pieces=False), _RECORDS).select(columns)
    if not files.crossed:
        return whole
    # At most two rows per split. A tail starts a record, and all pieces up to the next tail belong to it.
    pieces = lines.mapInArrow(_cutter(files.splits, pieces=True), _RECORDS)
    of = F.sum("tail").over(Window.partitionBy("rank").orderBy("start", "tail"))
    joined = pieces.withColumn("of", of).groupBy("rank", "latin", "part", "of").agg(
        F.max(F.when(F.col("tail") == 1, F.col("number"))).alias("number"),
        F.array_sort(F.collect_list(F.struct("start", "tail", "record"))).alias("pieces"),
    )
    text = F.expr("aggregate(slice(pieces, 2, size(pieces)), pieces[0].record, (a, p) -> concat(a, X'0A', p.record))")
    return whole.union(joined.select("rank", "latin", "part", "number", text.alias("record")))


def read_records(spark: SparkSession, path: str, files: CsvFiles, options: dict) -> DataFrame:
    """Cells of all surveyed files by column name, with _rank (of the file by name) and _place (in the file).

    A file that shares no column with the most frequent header is refused.
    """
    for header in files.headers[1:]:
        if not set(header) & set(files.headers[0]):
            raise DatasetError(f"A file with {', '.join(header)} has none of the columns {', '.join(files.headers[0])}.")
    width = max(map(len, files.headers), default=0)
    if not width:
        raise DatasetError(f"There is no record at {path}.")
    # Line ends are the parser's business within a record as well.
    text = F.when(F.col("latin"), F.decode("record", "ISO-8859-1")).otherwise(F.col("record").cast("string"))
    parser = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    cells = F.from_csv(F.rtrim(text, F.lit("\r")), ", ".join(f"_{i} string" for i in range(width)), parser)
    found = records(spark, path, files).filter("number > 0").select("rank", "part", "number", cells.alias("cells"))
    names = list(dict.fromkeys(n for header in files.headers for n in header))

    def column(name: str):
        value = F.lit(None).cast("string")
        for part, header in enumerate(files.headers):
            if name in header:
                value = F.when(F.col("part") == part, F.col(f"cells._{header.index(name)}")).otherwise(value)
        return value.alias(name) if len(files.headers) > 1 else F.col(f"cells._{files.headers[0].index(name)}").alias(name)

    return found.select(*map(column, names), F.col("rank").alias("_rank"), (F.col("number") - 1).alias("_place"))
