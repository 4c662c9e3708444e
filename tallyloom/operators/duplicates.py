"""Flag reviews whose text occurs more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions.numeric import identifier
from tallyloom.functions.text import text_key
from tallyloom.names import ROW_ID, TEXT_KEY, TEXT_PLACEHOLDER

FLAG = "is_duplicate_review_text"


def _keyed(df: DataFrame) -> DataFrame:
    """``row_id``, ``has_review_text`` and digest; a review without a text has the placeholder's."""
    if TEXT_KEY in df.columns:
        # A stored digest is NULL where there was no text; that stands for the placeholder.
        key = F.coalesce(TEXT_KEY, text_key(F.lit(TEXT_PLACEHOLDER)))
    else:
        key = text_key("review_text")
    return df.select(ROW_ID, "has_review_text", key.alias("_key"))


def digest_counts(df: DataFrame) -> DataFrame:
    """Per digest the number of reviews, and the smallest id of those with a text."""
    own = F.when(F.col("has_review_text"), F.col(ROW_ID))
    return _keyed(df).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(own).alias("_one"))


def _unique_ids(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col(ROW_ID).alias("_row")).agg(F.lit(True).alias("_flag"))


def repeated_review_rows(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``row_id`` of the reviews with a text that another review has too, each id once.

    Texts are read once; only ids and digests are shuffled. The reviews of a digest are dealt to as
    many slices as the session has shuffle partitions. Two of them in one slice are repeated.
    The first one of every slice then meets those of the other slices, which are no more than
    there are partitions. So no task gets much more than its share, however often a text occurs.
    With ``counts`` (``_key``, ``_n``) stored before, digests are looked up there instead.
    """
    keyed = _keyed(df)
    if counts is not None:
        return _looked_up(keyed, counts)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slice_of = F.pmod(F.xxhash64(ROW_ID), F.lit(parts))
    own = Window.partitionBy("_key", "_slice")
    dealt = keyed.withColumn("_slice", slice_of).withColumns({
        "_place": F.row_number().over(own.orderBy(ROW_ID)),
        "_here": F.count(F.lit(1)).over(own),
    })
    # Reviews behind the first of a slice are known to be repeated; a key of their own keeps them apart.
    apart = F.concat(F.col(ROW_ID).cast("string"), F.lit("/"), F.col("_place").cast("string")).cast("binary")
    met = dealt.withColumn("_meet", F.when(F.col("_place") == 1, F.col("_key")).otherwise(apart))
    slices = F.count(F.lit(1)).over(Window.partitionBy("_meet"))
    return _unique_ids(met.withColumn("_slices", slices).filter("has_review_text AND (_here > 1 OR _slices > 1)"))


def _looked_up(keyed: DataFrame, counts: DataFrame) -> DataFrame:
    """Reviews whose digest has a count above one.

    A digest with more rows than an even share of a shuffle partition is looked up by broadcast;
    there are fewer of those than the session has shuffle partitions. All others are joined.
    """
    repeated = counts.filter("_n > 1")
    share = counts.agg(F.sum("_n").alias("rows")).scalar()
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = repeated.filter(F.col("_n") * parts > share).select(F.col("_key").alias("_hot"))
    cold = repeated.select(F.col("_key").alias("_cold"))
    own = F.col(ROW_ID).cast("string").cast("binary")
    return _unique_ids(
        keyed.filter("has_review_text")
        .join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
        .withColumn("_seek", F.when(F.col("_hot").isNull(), F.col("_key")).otherwise(own))
        .join(cold, F.col("_seek") == F.col("_cold"), "left")
        .filter("_hot IS NOT NULL OR _cold IS NOT NULL")
    )


def add_flag(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the flag from a table of flagged rows with unique ids (``_row``, ``_flag``).

    A query that doesn't use the flag doesn't join: the ids are known to be unique. One that does
    joins those of its columns that it reads.
    """
    return df.join(rows, F.col(ROW_ID) == F.col("_row"), "left").select(
        *[F.col(identifier(c)) for c in df.columns], F.coalesce("_flag", F.lit(False)).alias(FLAG)
    )


def flag_duplicate_review_text(df: DataFrame) -> DataFrame:
    """Add ``is_duplicate_review_text``; the placeholder counts as a text but is never flagged."""
    return add_flag(df, repeated_review_rows(df))
