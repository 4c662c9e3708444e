"""Bring this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
#: Applications that have the package already.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once per application.

    Workers import functions by the name of their module, so they need the package wherever the
    driver was started. Spark serves the archive from the driver; an installed package does no harm.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(PACKAGE)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
