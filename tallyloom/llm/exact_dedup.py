"""Exact duplicates by progressive refinement: length, then hash of the beginning, then full hash.

Each step looks only at rows whose group survived the step before. Groups are counted with
partial counts, and what survives is passed on as a bitmap of fixed size, so no text is ever
shuffled: only ids and digests are. A text shared by a third of all rows is one row per task in
the counts; on the way back to the rows it is a skewed key of a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import key_bitmap, lowered, mark_possible, stored, whole_text

#: 2**24 bits: 2 MiB to every task. A fuller bitmap only spares less hashing.
BITS = 24
PREFIX = 64


def _repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def exact_duplicates(docs: DataFrame, bits: int = BITS, prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """Group documents with equal texts; of each group the row with the largest doc_id stays.

    Texts are equal when identical after lower-casing A-Z. Returns one row per input row: doc_id,
    keep_id, group_size, kept, text_sha256. The digest is null for a row that was told apart
    before its full content was read, unless ``digest_all`` asks for every digest.

    Null text counts as empty, and empty texts are equal to each other. A null doc_id is smaller
    than any other; a group of such rows only has a null keep_id and all of it is kept. Rows that
    repeat a doc_id and a text are one document and share its decision, each counted in
    group_size. Other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select("doc_id", whole_text().alias("text"))
    sized = base.withColumn("length", F.octet_length("text").cast("long"))
    lengths = key_bitmap(_repeated(sized, "length"), "length", bits)
    sized = mark_possible(sized, "length", lengths, bits, "same_length")
    begun = sized.withColumn(
        "begin",
        F.when(F.col("same_length"), F.xxhash64("length", lowered(F.substring("text", 1, prefix)))),
    )
    begins = key_bitmap(_repeated(begun.filter("begin is not null"), "begin"), "begin", bits)
    begun = mark_possible(begun, "begin", begins, bits, "same_begin")
    full = F.unhex(F.sha2(lowered("text"), 256))
    digest = full if digest_all else F.when(F.col("same_begin"), full)
    rows = stored(begun.select("doc_id", digest.alias("digest"), "same_begin"))

    groups = stored(
        rows.filter("same_begin").groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
