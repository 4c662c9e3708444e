"""A training corpus from raw documents: five stages, each working on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, line_dedup, pieces, simhash, toxicity
from tallyloom.llm.shared import stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels of docs, does not reject."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier already; one left without text goes.

    n_chars, where there is such a column, follows the text.
    """
    found = line_dedup.remove_passages(docs)
    left = found.filter((F.col("removed_lines") == 0) | (F.trim(F.translate("text", "\r\n\t", "   ")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("removed_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", changed)
    return left.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: the smallest doc_id, then text hash, then other columns.

    Null ids come last; of a group of null ids only, the row with the smallest text hash stays.
    """
    found = stored(simhash.with_first(docs).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "first"
    ))
    stays = F.col("__id").eqNullSafe(F.col("first.doc_id")) & (F.col("__hash") == F.col("first.text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    # Rows that repeat an id and a text: all go here, and one of them comes back.
    repeated = stored(
        found.filter(stays).groupBy("__id", "__hash").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    )
    dropped = stored(found.filter(~stays).select("__id", "__hash").distinct().union(repeated))
    single = (
        docs.join(repeated, same).groupBy("__id", "__hash").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    )
    return docs.join(dropped, same, "left_anti").union(single)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't consist of benchmark items to a twentieth or more."""
    found = decontam.find_benchmark(docs, _table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, their number n_pieces, and whether decoding gives the text again."""
    proto = pieces.load_model(spark)
    plain = F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return (
        pieces.encode(docs, proto, with_decoded=True)
        .withColumn("n_pieces", F.size("ids").cast("long"))
        .withColumn("round_trip", F.col("decoded") == plain)
        .drop("decoded")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Trained and learned stages cannot be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is stored before the next stage."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
