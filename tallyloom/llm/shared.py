"""Helpers of the corpus operators: stored tables, row keys, bitmaps of keys, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and about most bytes of a slice of a batch.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share; in local mode without one, a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach.")
    base = tempfile.mkdtemp(prefix="corpus-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there.

    A lost executor costs only the tasks it ran, not what came before, and Spark plans what
    follows with the table's true size. The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def stored_lean(df: DataFrame, by: str | None = None, rows: int = SLICE_ROWS) -> DataFrame | dict:
    """As ``stored``, with batches of so many rows; besides, the shuffle files of the write go as soon as it has ended.

    With a column of integers rows are stored apart by its values: the result gives a table, which
    may be empty, for any value.
    """
    conf = df.sparkSession.conf
    own = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        # As many rows as a slice has: batches of whole texts are held by both Spark and Python.
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
    }
    before = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        return stored(df) if by is None else _Apart(df, by)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


class _Apart(dict):
    """Tables by the value of a column, each with all columns."""

    def __init__(self, df: DataFrame, by: str):
        spark, self.schema, self.by = df.sparkSession, df.schema, by
        self.path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
        df.withColumn("__by", F.col(by)).write.partitionBy("__by").parquet(self.path)
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self.folder = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.files = self.folder(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.folder(self.path))

    def __missing__(self, value: int) -> DataFrame:
        path = f"{self.path}/__by={value}"
        if not self.files.exists(self.folder(path)):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing needs any more."""
    for table in tables:
        spark = table.sparkSession
        path = {p.rsplit("/", 1)[0] for p in table.inputFiles()}
        for folder in path:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lowered(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def whole_text() -> Column:
    return F.coalesce("text", F.lit(""))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number; it divides documents into folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % modulus


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of batches in slices of bounded size, so that what Python makes of them stays small."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def by_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """Apply a function from a dict of Arrow columns to a dict of lists to all rows."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = function(dict(zip(part.schema.names, part.columns)))
            arrays = [
                x.cast(f.type) if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, spark_schema)


def texts(column: pa.Array) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


# A set of 64-bit keys as a bitmap of fixed size. A clear bit proves that a key is absent, so
# work can be skipped for it; a set bit proves nothing and is always followed by an exact step.


def key_bitmap(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """Bitmap of 2**bits bits: at most 2**(bits - 15) rows of 4 KiB, whatever the number of keys."""
    place = F.expr(f"{column} & {(1 << bits) - 1}L")
    return (
        keys.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bitmap_part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    )


def mark_possible(df: DataFrame, column: str, bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add a boolean: false where the key's bit is clear. The broadcast is bounded by 2**bits bits."""
    place = F.expr(f"{column} & {(1 << bits) - 1}L")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    part = bitmap.withColumnRenamed("bitmap_part", "__part")
    return (
        df.withColumn("__own", F.bitmap_bucket_number(place))
        .join(F.broadcast(part), F.col("__own") == F.col("__part"), "left")
        .withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
        .drop("__own", "__part", "bitmap")
    )
