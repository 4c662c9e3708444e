"""Named queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op2_exact_dedup(spark, folder):
    from tallyloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, folder, "documents"), digest_all=True)


@query
def op3_decontamination(spark, folder):
    from tallyloom.llm.decontam import find_benchmark

    found = find_benchmark(
        _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op4_simhash(spark, folder):
    from tallyloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, folder, "documents")).drop("text_hash")


@query
def op10_toxicity(spark, folder):
    from tallyloom.llm.toxicity import score_toxicity, train

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, folder, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


@query
def op7_line_dedup(spark, folder):
    from tallyloom.llm.line_dedup import remove_passages

    found = remove_passages(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "removed_lines", "removed_words",
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query
def op5_sentencepiece(spark, folder):
    from tallyloom.llm import pieces

    proto = pieces.load_model(spark)
    back = pieces.encode(_table(spark, folder, "documents").select("doc_id", "text"), proto, with_decoded=True)
    as_text = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(as_text, 256).alias("ids_sha256"),
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")).alias("round_trip"),
    )


@query
def op8_language_model(spark, folder):
    from tallyloom.llm import pitman_yor as hpy, word_contexts

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = word_contexts.train(docs.filter(~hpy.held_out()), docs.filter(hpy.held_out()))
    return word_contexts.score(docs, model, listed=True).select(
        "doc_id", hpy.held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


@query
def op1_html_text(spark, folder):
    from tallyloom.llm.html_text import extract_main_text

    return extract_main_text(_table(spark, folder, "pages")).drop("slots")


@query
def op6_personal_data(spark, folder):
    from tallyloom.llm import personal_data as pii

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])

    def digest(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.BASE),
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest("spans").alias("spans"),
    )


@query
def op9_quality(spark, folder):
    from tallyloom.llm.quality import score_quality, train

    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return score_quality(docs, labels, train(docs, labels))


@query
def op11_centroids(spark, folder):
    from tallyloom.llm.centroids import centroid_table, cluster

    found = cluster(_table(spark, folder, "embeddings"))
    rows = found.rows.select(F.col("id").alias("vec_id"), F.col("first").alias("cluster"), F.col("square").alias("distance"))
    return rows.join(F.broadcast(centroid_table(spark, found)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@query
def op12_spelling(spark, folder):
    from tallyloom.llm.shared import stored
    from tallyloom.llm.spelling import count_words, word_forms

    return word_forms(stored(count_words(_table(spark, folder, "documents").select("doc_id", "text"))))


@query
def op13_suffix_dedup(spark, folder):
    from tallyloom.llm.suffix_family import remove_repeats

    found = remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
