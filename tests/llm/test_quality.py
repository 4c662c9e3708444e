import math
import random

import numpy as np
import pytest

from tallyloom.llm.quality import Model, properties, score_quality, train


def table(spark, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(900):
        host = rng.choice(["good.org"] * 5 + ["bad.net"] * 3 + [f"one{i}.com", None])
        fine = rng.random() < {"good.org": 0.95, "bad.net": 0.15}.get(host, 0.6)
        if fine:
            text = " ".join(rng.choice("river stone walks under light often every small".split()) + rng.choice("abcdefgh") for _ in range(60)) + "."
        else:
            text = " ".join(rng.choice(["$$$", "!!!", "BUY", "now"]) for _ in range(60))
        rows.append((i, text, rng.choice(["a", "b", None]), host, "clash"))
        if rng.random() < 0.6:
            labels.append((i, int(fine), 0))
    rows += [(2000, None, "a", "good.org", "x"), (2001, "", "a", "bad.net", "x"), (None, "word", None, None, "x"), (5, rows[5][1], "b", "x.y", "x")]
    labels += [(3, None, 0), (None, 1, 0), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_documents_and_shrinkage(spark):
    docs, labels, rows = table(spark)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    found = score_quality(docs, labels, train(docs, labels)).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    hosts = {r[0]: r[3] for r in rows}
    means = {hosts[r.doc_id]: r.host_mean for r in found if r.doc_id is not None and r.doc_id != 5}
    overall = np.mean([r.host_mean for r in found])
    assert means["good.org"] > 0.85 and means["bad.net"] < 0.3
    lone = [m for h, m in means.items() if h and h.startswith("one")]
    assert all(abs(m - overall) < 0.45 for m in lone)
    empty = {r.doc_id: r for r in found if r.doc_id in (2000, 2001)}
    assert empty[2000].score > empty[2001].score


def test_path_mean_leaves_the_document_out(spark):
    docs, labels, _ = table(spark, 2)
    model = Model(prior=0.5)
    found = {r.doc_id: r for r in score_quality(docs, labels.limit(0), model).collect()}
    assert all(math.isclose(r.doc_score, 0.5) and math.isclose(r.path_mean, 0.5, abs_tol=0.01) for r in found.values())


def test_no_labels_and_no_rows(spark):
    docs, labels, rows = table(spark)
    assert score_quality(docs, labels.limit(0), train(docs, labels.limit(0))).count() == len(rows)
    assert score_quality(docs.limit(0), labels, train(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("text", [None, "", "   \n", "x", "é " * 50000])
def test_properties_are_finite(text):
    assert len(properties(text)) == 11 and all(math.isfinite(x) for x in properties(text))
