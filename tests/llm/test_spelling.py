"""Spelling variants against a comparison of every word with every other."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import spelling
from tallyloom.llm.spelling import count_words, near, near_words, word_forms


def plain_words(rows, min_length=6, min_count=5):
    found = Counter()
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= min_count}


def edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_forms(n):
    close = {w: [] for w in n}
    for a, b in itertools.combinations(sorted(n), 2):
        if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1:
            close[a].append(b)
            close[b].append(a)
    form = {w: min(c, key=lambda x: (-n[x], x)) if c else None for w, c in close.items()}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(close[w]), n[form[w]] if form[w] else 0) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def damaged(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    if kind == 0:
        return word[:i] + word[i + 1 :]
    return word[:i] + rng.choice(letters) + word[i + (kind == 1) :]


def vocabulary(rng, bases, letters, length=(6, 12)):
    n = {}
    for _ in range(bases):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(*length)))
        n[word] = 10 ** rng.randint(1, 4)
        for _ in range(12):
            word = damaged(rng, word, letters)
            if len(word) >= 3:
                n.setdefault(word, rng.choice([1, 2, 5, 10, 50, 250, 1250]))
    return n


@pytest.mark.parametrize("letters,chunk,slice_", [("abcdefghij", 1 << 15, 1 << 16), ("ab", 30, 50), ("aeqsäÿ×", 64, 1 << 16)])
def test_equals_comparison_of_all_pairs(spark, letters, chunk, slice_, monkeypatch):
    n = vocabulary(random.Random(len(letters)), 40, letters)
    # Long words, near each other across the width up to which words are verified side by side.
    long = letters[0] * 30 + letters[1] * 34
    n |= {long: 500, long + letters[0]: 7, long[:-1]: 3, long * 5: 100, long * 2 + letters[1] + long * 3: 1, "z" + long: 2}
    monkeypatch.setattr(spelling, "STEP", 100)
    df = spark.createDataFrame([(w, c, "x", 1) for w, c in n.items()], "word string, n long, root string, path int")
    expected = plain_forms(n)
    assert any(r[1] and r[2] != r[1] for r in expected)
    if chunk < 1 << 15:
        found = {r.word: (r.n_near, r.best_n) for r in near_words(df, chunk, slice_).collect()}
        assert found == {r[0]: (r[4], found[r[0]][1]) for r in expected if r[4]}
    assert rows_of(word_forms(df)) == expected


def test_documents_equal_plain_words(spark):
    rng = random.Random(9)
    words = ["Straßeßen", "haÀÿlight", "Garden", "GARDENS", "gardén", "kitchen", "short", "kitchens", "a1garden2b", "×÷éèêë"]
    rows = [(rng.choice([i, None]), rng.choice(["", " ", "-"]).join(rng.choice(words) + rng.choice([" ", "_", "Ā"]) for _ in range(40))) for i in range(300)]
    rows += [(1, None), (2, ""), (3, "garden " * 30000), (3, "garden " * 30000)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    n = plain_words(rows)
    assert {r.word: r.n for r in count_words(docs).collect()} == n and len(n) > 8
    assert rows_of(word_forms(count_words(docs))) == plain_forms(n)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert word_forms(count_words(docs)).count() == 0
    one = spark.createDataFrame([("single", 5)], "word string, n long")
    assert rows_of(word_forms(one)) == [("single", "", "single", 5, 0, 0)]


def test_near_equals_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        b = damaged(rng, damaged(rng, a, "ab") or "a", "ab") if rng.random() < 0.5 else damaged(rng, a, "abc")
        assert near(a.encode(), b.encode()) == (edits(a, b) == 1)


def test_search_finds_all_within_the_budget():
    rng = np.random.default_rng(5)
    counts, searching = rng.integers(0, 3, (200, 5)), rng.integers(0, 3, (100, 5))
    up, down = rng.integers(0, 2, 100), rng.integers(0, 2, 100)
    found = sorted((i, j) for q, w in spelling._Trie(counts).search(searching, up, down) for i, j in zip(q.tolist(), w.tolist()))
    diff = counts[None] - searching[:, None]
    fits = (np.clip(diff, 0, None).sum(axis=2) + up[:, None] <= 1) & (np.clip(-diff, 0, None).sum(axis=2) + down[:, None] <= 1)
    assert found == [tuple(x) for x in np.argwhere(fits).tolist()]
