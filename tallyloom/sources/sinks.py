"""Export of any result: CSV with a header (UTF-8, without byte order mark) or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.sources.schema_check import DatasetError


# Fixed value: most rows of a compressed file, which is read by one task.
PACKED_ROWS = 50_000


def export(df: DataFrame, path: str, fmt: str = "csv", compression: str | None = None) -> None:
    """Write ``df`` to a new folder, one file per partition; of a compressed CSV, several smaller ones.

    Plain CSV is read back in splits; a compressed file can't be cut, so it is kept small instead.
    """
    if fmt == "csv":
        packed = {"compression": compression, "maxRecordsPerFile": PACKED_ROWS} if compression else {}
        df.write.mode("errorifexists").options(**packed).csv(path, header=True, quote='"', escape='"', emptyValue='""')
    elif fmt == "parquet":
        df.write.mode("errorifexists").parquet(path)
    else:
        raise DatasetError(f"Cannot write format '{fmt}'.")
