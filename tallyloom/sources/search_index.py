"""A trigram index beside a layer: which groups of reviews can hold a literal term.

Reviews are taken in granules of up to ``GRANULE`` rows of one file. For every sequence of three
bytes that occurs in the searched texts of a granule, the granule's bit is set in the bitmaps of
that trigram. A term occurs only in granules that have all its trigrams; only their files are read,
and each of their reviews is verified, so the result does not hang on the index. Terms of fewer
than three bytes have no trigram, and all files are read for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.functions.text import haystack

GRANULE = 4_096
# Granules whose bits share a bitmap: fixed by Spark's bitmap functions.
BITMAP = 32_768


def _trigrams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of the three-byte sequences of texts put one behind the other; none crosses an end."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int32)
    wide = data.astype(np.int32)
    codes = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    inside = np.ones(len(data) + 2, dtype=bool)
    for back in (1, 2):
        inside[np.maximum(ends - back, 0)] = False
    return np.unique(codes[inside[: len(codes)]])


def term_codes(term: str) -> list[int]:
    data = np.frombuffer(term.encode(), dtype=np.uint8)
    return _trigrams(data, np.array([len(data)])).tolist()


def _granules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, place and the trigrams of up to GRANULE texts of one split."""
    schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("codes", pa.list_(pa.int32()))])
    place = 0
    for batch in batches:
        file, start = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        edges = sorted({*range(0, batch.num_rows, GRANULE), *cuts.tolist(), batch.num_rows})
        for a, b in zip(edges, edges[1:]):
            texts = batch.column(2).slice(a, b - a)
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
            found = _trigrams(data, offsets[1:] - offsets[0])
            row = {"file": int(file[a]), "start": int(start[a]), "place": place, "codes": found}
            place += 1
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def write_search_index(spark: SparkSession, reviews: str, folder: str) -> None:
    """Index the stored reviews of a folder: tables ``granules`` (granule, file) and ``trigrams`` below another.

    One pass over the texts; what is shuffled are trigrams per granule, a few per review.
    """
    stored = spark.read.parquet(reviews)
    texts = stored.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.coalesce(haystack("review_text", "title"), F.lit("")).alias("text"),
    )
    texts.mapInArrow(_granules, "file long, start long, place long, codes array<int>").write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    # One row per granule is numbered; numbers have to be dense for the bitmaps to be.
    key = ["file", "start", "place"]
    numbered = parts.select(*key).withColumn("granule", F.row_number().over(Window.orderBy(*key)).cast("long"))
    # The list of files spells an empty host, the metadata of rows doesn't.
    paths = [(re.sub(r"^(\w+):///", r"\1:/", p), p) for p in stored.inputFiles()]
    names = spark.createDataFrame(paths, "path string, listed string").select(F.xxhash64("path").alias("file"), F.regexp_extract("listed", "[^/]*$", 0).alias("name"))
    numbered.join(names, "file").select(*key, "granule", "name").write.parquet(f"{folder}/granules")
    granules = spark.read.parquet(f"{folder}/granules")
    pairs = parts.join(granules, key).select(F.explode("codes").alias("code"), "granule")
    bitmaps = pairs.groupBy("code", F.bitmap_bucket_number("granule").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("granule")).alias("bits")
    )
    # Sorted, so that a look-up reads the pages of its trigrams only.
    bitmaps.repartitionByRange("code").sortWithinPartitions("code", "bucket").write.parquet(f"{folder}/trigrams")


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    folder: str
    reviews: str

    def files(self, term: str) -> list[str] | None:
        """Paths of the files that can hold a lower-case term, or None if it is too short to tell.

        To the driver come one bit per granule and trigram of the term, and names of files.
        """
        codes = term_codes(term)
        if not codes:
            return None
        found = self.spark.read.parquet(f"{self.folder}/trigrams").filter(F.col("code").isin(codes)).collect()
        buckets: dict[int, list[np.ndarray]] = {}
        for r in found:
            buckets.setdefault(r["bucket"], []).append(np.frombuffer(bytes(r["bits"]), dtype=np.uint8))
        hits: list[int] = []
        for bucket, bitmaps in buckets.items():
            if len(bitmaps) == len(codes):
                both = np.bitwise_and.reduce(np.stack([np.pad(b, (0, BITMAP // 8 - len(b))) for b in bitmaps]))
                # Granules and buckets count from one, bits from the lowest of each byte.
                hits += (np.flatnonzero(np.unpackbits(both, bitorder="little")) + (bucket - 1) * BITMAP + 1).tolist()
        if not hits:
            return []
        granules = self.spark.read.parquet(f"{self.folder}/granules")
        wanted = self.spark.createDataFrame([(h,) for h in hits], "granule long")
        names = granules.join(wanted, "granule").select("name").distinct().collect()
        return sorted(f"{self.reviews}/{r['name']}" for r in names)
