"""Text digests of a layer in buckets, so that further reviews find repeated texts without old texts.

A part of a layer has a table with one row per digest: how many reviews have it, and one of those
with a text. All parts are bucketed and sorted alike by digest, so parts are joined bucket by bucket
and neither side is shuffled. Tables are declared over their files when they are opened; nothing
hangs on the catalog they were written with.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = "_key"


def _name(path: str) -> str:
    return f"digests_{hashlib.md5(path.encode()).hexdigest()}"


def write_digests(counts: DataFrame, path: str, buckets: int) -> None:
    """Store digest counts (``_key``, ``_n``, ``_one``), one file per bucket."""
    counts.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(_name(path))


def open_digests(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    kind = dict(spark.read.parquet(path).dtypes)["_one"]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(path)} ({KEY} BINARY, _n BIGINT, _one {kind}) USING parquet "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_name(path))


def merge_digests(own: DataFrame, earlier: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Counts of a part's digests over all parts, and ids (``_row``) of earlier reviews that were the only ones."""
    counts = own
    joins = []
    for i, old in enumerate(earlier):
        old = old.select(F.col(KEY).alias(f"key_{i}"), F.col("_n").alias(f"n_{i}"), F.col("_one").alias(f"one_{i}"))
        counts = counts.join(old, F.col(KEY) == F.col(f"key_{i}"), "left")
        joins.append(own.select(KEY).join(old, F.col(KEY) == F.col(f"key_{i}")).filter(f"n_{i} = 1").select(F.col(f"one_{i}").alias("_row")))
    total = sum((F.coalesce(f"n_{i}", F.lit(0)) for i in range(len(earlier))), F.col("_n"))
    single = joins[0]
    for more in joins[1:]:
        single = single.union(more)
    return counts.select(KEY, total.alias("_n")), single.filter("_row IS NOT NULL")
