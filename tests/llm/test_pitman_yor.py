import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import pitman_yor as P


def table(spark, seed=3, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "of", "cat.", "sat", "É", "on", *(f"w{i}" for i in range(300))]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([7, 40, 300])]) for _ in range(rng.randint(0, 80))), "x") for i in range(n)]
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "the cat.", "x"), rows[5], (1002, "the " * 50000, "x"), (1003, "nowhere-else seen", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), rows


def learned(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


@pytest.fixture(scope="module")
def trained(spark):
    docs, rows = table(spark)
    return docs, rows, P.train(docs.filter(~P.held_out()), contexts=10)


def test_base_scores_and_counts_equal_plain_ones(trained):
    docs, rows, model = trained
    counts = Counter(w for i, t, _ in rows if learned(i) for w in P.tokens(t))
    total, size = sum(counts.values()), len(counts)
    assert (model.n_tokens, model.vocabulary) == (total, size)
    expected = sorted(
        (len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (total + size + 1)) for x in w), 6))
        for w in (P.tokens(t) for _, t, _ in rows)
    )
    for head in (5, 1 << 15):
        found = P.score(docs, model, head).collect()
        own = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found)
        assert np.allclose(np.array(own), np.array(expected), atol=1e-5)


def test_scores_equal_the_model_and_it_sums_to_one(trained):
    docs, rows, model = trained
    words = {bytes(r.word): r for r in model.words.collect()}

    def p(word, ctx):
        row = words.get(word)
        if row is not None and ctx in row.ctx:
            return row.p[row.ctx.index(ctx)]
        parent = np.array(row.parent) if row is not None else model.unknown
        return float(np.mean(parent * model.backing[:, ctx]))

    for ctx in range(len(model.contexts)):
        assert sum(p(w, ctx) for w in words) + p(b"never seen", ctx) == pytest.approx(1)
    by_head = [sorted((r.n_tokens, r.score) for r in P.score(docs, model, head).collect()) for head in (3, 1 << 15)]
    expected = []
    for _, text, _ in rows:
        w = P.tokens(text)
        before = [model.contexts.start] + [model.contexts.numbers.get(x, model.contexts.other) for x in w[:-1]]
        expected.append((len(w), sum(math.log10(p(x, c)) for x, c in zip(w, before))))
    for found in by_head:
        assert np.allclose(np.array(found), np.array(sorted(expected)), rtol=1e-4)


def test_seating_in_blocks_agrees_with_one_by_one():
    rng = np.random.default_rng(1)
    n, count = 4000, 300
    given = np.full(n, count), np.full(n, 50.0), np.full(n, 0.02)
    quick = P.seat(*given, 0.5, 10.0, rng)
    tables = np.ones(n)
    for i in range(1, count):
        new = (10.0 + 0.5 * (50.0 + tables)) * 0.02
        tables += rng.random(n) * (new + i - 0.5 * tables) < new
    assert abs(quick.mean() - tables.mean()) < 0.05 * tables.mean() and quick.max() <= count
    assert (P.seat(np.ones(5, int), np.zeros(5), np.full(5, 0.1), 0.5, 1.0, rng) == 1).all()


def test_empty_tables(spark):
    docs, rows = table(spark, n=9)
    model = P.train(docs.limit(0))
    found = P.score(docs, model).collect()
    assert len(found) == len(rows) and all(r.score == r.base_score == 0 and r.n_known == 0 for r in found)
    assert P.score(docs.limit(0), model).count() == 0
