"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import stored


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges; equal when nothing has changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(lowest, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(lowest.select("u", F.col("low").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """Node and root, the smallest node of its component, for every node with an edge but the roots.

    ``edges`` has two columns of one type; direction and repetition don't matter. Alternates the
    two star operations until nothing changes, a number of rounds in the order of the logarithm
    of the nodes. Each round is stored in the shared folder; nothing is brought to the driver but
    a count and a hash.
    """
    u, v = edges.columns
    current = stored(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct()
    )
    mark = _mark(current)
    while mark[0]:
        current = stored(_small_star(_large_star(current).filter("u != v").distinct()).distinct())
        before, mark = mark, _mark(current)
        if mark == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
