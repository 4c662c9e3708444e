"""The registered queries over the smallest tables: their columns, rows, and SQL where there is one."""

import hashlib

import pytest

from oracle import connect, differences
from tallyloom.llm.oracle import ORACLE_SQL
from tallyloom.llm.queries import QUERIES
from test_personal_data import plain_spans

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_text": ["page_id", "url", "text", "n_chars"],
    "op2_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op5_sentencepiece": ["doc_id", "n_pieces", "ids_sha256", "round_trip"],
    "op6_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_line_dedup": ["doc_id", "removed_lines", "removed_words", "n_chars_left", "text_sha256"],
    "op8_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_quality": ["doc_id", "held_out", "doc_score", "host_mean", "path_mean", "score", "kept"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op12_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    found = QUERIES[name](spark, FOLDER)
    assert found.columns == COLUMNS[name]
    if name in ORACLE_SQL:
        assert differences(found, connect(FOLDER), ORACLE_SQL[name]) == []
        return
    table = "pages" if name == "op1_html_text" else "documents"
    rows = found.collect()
    key = found.columns[0]
    ids = [r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()]
    assert sorted(r[key] for r in rows) == sorted(ids)


def test_base_digests_of_personal_data(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for row in QUERIES["op6_personal_data"](spark, FOLDER).collect():
        spans = plain_spans(texts[row.doc_id] or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        counts = [sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone")]
        assert row.base_sha256 == digest and [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
