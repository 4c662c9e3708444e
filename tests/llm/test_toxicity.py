import random
import zlib

import numpy as np

from tallyloom.llm import toxicity as T


def table(spark, seed=1, n=900):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["zqlout", "zqlerin", "wyxbad", "wyxbadly", "uglyword"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "x", 0.5))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
    rows += [(5001, None, "x", 0.5), (5002, "", "x", 0.5), (None, "zqlout " + plain[0], "x", 0.5), rows[3], (5003, plain[1] + " " * 50000 + "zqlerin", "x", 0.5)]
    labels += [(3, 1, None), (None, 1, 1), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def truth(text):
    return any(w[:3] in ("zql", "wyx") or w == "uglyword" for w in (text or "").split())


def test_held_out_documents(spark):
    docs, labels, rows = table(spark)
    model = T.train(docs, labels)
    scored = T.score_toxicity(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "score", "held_out", "predicted"]
    found = scored.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    held = [r for r in found if r.held_out]
    assert np.mean([(r.predicted == 1) == truth(r.text) for r in held]) > 0.98
    by = {r.doc_id: r for r in found}
    assert by[5001].predicted == by[5002].predicted == 0 and by[5003].predicted == 1
    assert by[None].predicted == 1 and not by[None].held_out
    again = {r.doc_id: r.score for r in T.score_toxicity(docs.repartition(3), T.train(docs.repartition(5), labels)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in found)


def test_held_out_labels_are_not_used(spark):
    docs, labels, _ = table(spark, 2)
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.score_toxicity(docs, T.train(docs, x)).select("score").collect() for x in (labels, turned))
    assert sorted(a) == sorted(b)


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(3)
    label = rng.random(5000) < 0.3
    votes, fixed = {}, {}
    n = len(T.VOTERS)
    for y in label:
        first = rng.random() < (0.9 if y else 0.05)
        bits = [first, first] + [rng.random() < (0.8 if y else 0.1) for _ in range(3)] + [rng.random() < 0.02 for _ in range(n - 5)]
        v = sum(int(b) << i for i, b in enumerate(bits))
        votes[v] = votes.get(v, 0) + 1
        if rng.random() < 0.2:
            fixed[v, int(y)] = fixed.get((v, int(y)), 0) + 1
    firing, discount, prior = T.label_model(votes, fixed)
    assert discount[0] < 0.6 and discount[2] > 0.75
    assert abs(firing[1, 2] - 0.8) < 0.05 and abs(firing[0, 2] - 0.1) < 0.03 and abs(prior - 0.3) < 0.05


def test_without_labels_or_rows(spark):
    docs, labels, rows = table(spark, 4, 60)
    none = labels.limit(0)
    assert {r.score for r in T.score_toxicity(docs, T.train(docs, none)).collect()} == {0.0}
    empty = docs.limit(0)
    assert T.score_toxicity(empty, T.train(empty, labels)).count() == 0


def test_words_behind_inner_marks_are_seen():
    words, n = T.words_of("end.Idiot you/idiot dumb,idiot 1idiot2 a_b (you're) \u0939\u093f\u0928\u094d\u0926\u0940! ide\u0301e 12 --")
    assert n == 10
    assert words == {"end", "idiot", "you", "dumb", "a", "b", "re", "\u0939\u093f\u0928\u094d\u0926\u0940", "ide\u0301e"}
    model = T.Model(terms={"idiot": 0}, roots=frozenset({"idio"}))
    for text in ("end.Idiot", "you/idiot", "1idiot", "idiot"):
        assert T.matches(text, model)[0] == [0]
    assert T.matches("you'll see", model) == T.matches("you see", model)
