import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_pitman_yor import learned, table
from tallyloom.llm import pitman_yor as P
from tallyloom.llm import word_contexts as W
from tallyloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def trained(spark):
    docs, rows = table(spark)
    return docs, rows, W.train(docs.filter(~P.held_out()), docs.filter(P.held_out()))


def test_pairs_and_base_scores_equal_plain_ones(trained):
    docs, rows, model = trained
    counts, pairs, every = Counter(), Counter(), set()
    for i, t, _ in rows:
        words = P.tokens(t)
        own = [b" ".join(x) for x in zip([b"", *words], words)]
        every.update(own)
        if learned(i):
            counts.update(words)
            pairs.update(own)
    assert {r.pair.encode(): r.n for r in model.pairs.collect()} == {p: pairs[p] for p in every}
    total, size = sum(counts.values()), len(counts)
    assert (model.n_tokens, model.vocabulary) == (total, size)
    expected = sorted(
        (len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (total + size + 1)) for x in w), 6))
        for w in (P.tokens(t) for _, t, _ in rows)
    )
    for options in ({"listed": True}, {"hot": 5, "parts": 1}):
        found = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in W.score(docs, model, **options).collect())
        assert np.allclose(np.array(found), np.array(expected), atol=1e-5)


def test_scores_equal_the_model_and_every_context_sums_to_one(spark, trained):
    docs, rows, model = trained
    words = [r.word for r in model.words.select("word").collect()] + ["never-seen"]
    contexts = ["", "the", "w299", "never-seen"]
    pairs = spark.createDataFrame([(f"{c} {w}",) for c in contexts for w in words], "pair string")
    zero = F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t")
    found = W.pair_scores(model, pairs.join(model.pairs, "pair", "left").select("pair", *zero))
    sums = found.groupBy(F.substring_index("pair", " ", 1).alias("c")).agg(F.sum(F.expr("power(10, score)")).alias("p"))
    assert {r.c: pytest.approx(1) for r in sums.collect()} == {r.c: r.p for r in sums.collect()} and sums.count() == 4
    p = {r.pair.encode(): r.score for r in W.pair_scores(model, model.pairs).collect()}
    expected = []
    for _, text, _ in rows:
        w = P.tokens(text)
        expected.append((len(w), sum(p[b" ".join(x)] for x in zip([b"", *w], w))))
    for options in ({"listed": True}, {"hot": 3, "parts": 3}):
        got = sorted((r.n_tokens, r.score) for r in W.score(docs, model, **options).collect())
        assert np.allclose(np.array(got), np.array(sorted(expected)), rtol=1e-6)


def test_rare_previous_words_have_their_own_restaurants(spark, tmp_path):
    """400 previous words of equal frequency, each followed by a word of its own: far more than 126."""
    rows = [(i, " ".join(f"a{j} b{j}" for j in range(i % 40, 400, 40)) + " ") for i in range(800)]
    swapped = [(2000 + i, " ".join(f"a{j} b{(j + 40) % 400}" for j in range(i, 400, 40))) for i in range(40)]
    spark.createDataFrame(rows + [x for x in swapped if not learned(x[0])], "doc_id long, text string").coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = {r.doc_id: r.score for r in QUERIES["op8_language_model"](spark, str(tmp_path)).collect()}
    held = [i for i in found if i < 2000 and not learned(i)]
    # A word that always follows its previous one is nearly certain there, and most unlikely behind another.
    assert min(found[i] for i in held) > max(s for i, s in found.items() if i >= 2000) + 10


def test_empty_tables(spark):
    docs, rows = table(spark, n=9)
    model = W.train(docs.limit(0))
    found = W.score(docs, model).collect()
    assert len(found) == len(rows) and all(r.score == r.base_score == 0 and r.n_known == 0 for r in found)
    assert W.score(docs.limit(0), model).count() == 0
