"""A raw review table derived from the given order, part, customer and document tables.

Every order becomes one review: its priority is the rating, its line count the helpful votes,
its customer supplies age and department, nation and region supply class and division, and a
document is the text. Missing, invalid and repeated values are planted by rule on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.names import ROW_ID


def reviews_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    key = F.col("o_orderkey")
    planted = lambda step, value, otherwise: F.when(key % step == 0, value).otherwise(otherwise)
    null = F.lit(None).cast("double")

    lines = table("lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("part"), F.count(F.lit(1)).alias("votes")
    )
    customers = table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    titles = table("part").filter(F.col("p_type") != "ECONOMY").select("p_partkey", "p_name")
    texts = table("documents").select("doc_id", "text")
    # One document number in eleven does not exist, which leaves those reviews without text.
    numbers = texts.agg(F.expr("count(1) * 11 div 10").alias("n")).scalar()

    stars = F.substring("o_orderpriority", 1, 1).cast("int")
    mood = stars + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    orders = table("orders").select(
        key.alias(ROW_ID),
        F.col("o_custkey"),
        (key % numbers).alias("doc"),
        planted(211, F.lit(7.0), planted(223, null, stars.cast("double"))).alias("rating"),
        planted(
            149, F.lit(2.0), planted(151, null, F.when(mood >= 4, 1.0).otherwise(0.0))
        ).alias("recommended_ind"),
    )
    row = F.col(ROW_ID)
    return (
        orders.join(lines, row == F.col("l_orderkey"), "left")
        .join(titles, F.col("part") == F.col("p_partkey"), "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        # Rows grow by their text here. A merge join spreads that over all shuffle partitions
        # even where the texts are few enough to be broadcast to a handful of tasks.
        .join(texts.hint("merge"), F.col("doc") == F.col("doc_id"), "left")
        .select(
            ROW_ID,
            F.col("part").alias("clothing_id"),
            F.when(F.col("c_custkey") % 97 != 0, 15.0 + F.col("c_custkey") % 60)
            .cast("double").alias("age"),
            F.col("p_name").alias("title"),
            F.when(row % 20 == 0, F.col("text"))
            .otherwise(F.concat("text", F.lit(" #"), row.cast("string"))).alias("review_text"),
            "rating",
            "recommended_ind",
            F.col("votes").cast("double").alias("positive_feedback_count"),
            F.col("r_name").alias("division_name"),
            F.when(row % 131 != 0, F.col("c_mktsegment")).alias("department_name"),
            F.col("n_name").alias("class_name"),
        )
    )
