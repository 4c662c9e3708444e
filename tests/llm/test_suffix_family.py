"""Removal of repeated strings against a comparison of all strings."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import suffix_family
from tallyloom.llm.suffix_family import SuffixFamily, remove_repeats

SCHEMA = "doc_id long, text string, hash long, start string, key int"
LENGTH = 50


def plain(rows):
    """doc_id, kept and spans per row, with a table of every string."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - LENGTH + 1):
            if doc_id is not None:
                s = data[i : i + LENGTH]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data) + 1)
        for i in range(len(data) - LENGTH + 1):
            if doc_id is not None and first[data[i : i + LENGTH]] < doc_id:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = [i for i in range(len(data) + 1) if gone[i] != (gone[i - 1] if i else 0)]
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((str(doc_id), len(data), tuple(zip(spans[::2], spans[1::2])), kept))
    return sorted(out)


def found_rows(df):
    return sorted((str(r.doc_id), r.n_bytes, tuple((s["start"], s["end"]) for s in r.spans), bytes(r.kept)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], SCHEMA)


def corpus(rng, n, letters):
    fresh = lambda size: "".join(rng.choice(letters) for _ in range(size))
    passages = [fresh(rng.randint(45, 140)) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 1 and rows:
            text = rng.choice(rows)[1] or ""
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(letters) + text[at + rng.randint(0, 2) :]
        else:
            text = "".join(rng.choice([fresh(rng.randint(0, 60)), rng.choice(passages), rng.choice(passages)[5:-7]]) for _ in range(rng.randint(0, 6)))
        rows.append((1000 - 7 * i if i % 2 else 7 * i, text))
    return rows


@pytest.mark.parametrize("letters,batches", [("abcdefghijklmnop ", 4), ("ab", 1), ("aé漢\U0001f600", 3)])
def test_equals_comparison_of_all_strings(spark, letters, batches):
    rng = random.Random(len(letters))
    rows = corpus(rng, 60, letters)
    rows += [(3, "ab" * 400), (5, "ba" * 300 + "x"), (9000, "a" * 700), (9001, "a" * 200), (9002, "a" * 50), (9003, "a" * 49)]
    assert found_rows(remove_repeats(frame(spark, rows), batches)) == plain(rows)


def test_equal_ids_nulls_and_repeated_rows(spark):
    rng = random.Random(1)
    fresh = lambda size: "".join(rng.choice("abcdefgh") for _ in range(size))
    a, b = fresh(120), fresh(90)
    rows = [(1, a), (1, a), (1, b + a), (2, b), (2, b), (None, a), (None, b), (3, None), (4, ""), (5, a[10:59]), (6, "x" + a[10:60]), (7, a + b)]
    assert found_rows(remove_repeats(frame(spark, rows), 2)) == plain(rows)
    nulls = [(None, a), (None, a)]
    assert found_rows(remove_repeats(frame(spark, nulls))) == plain(nulls)


def test_long_text_and_common_passage(spark):
    """A text of several pieces, and a passage that most documents share in different surroundings."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(260_000))
    assert len(long) > 2 * suffix_family.PIECE
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows = [(0, long), (1, "start " + long[suffix_family.PIECE - 300 : suffix_family.PIECE + 5000] + " end"), (2, long[:-1])]
    rows += [(10 + i, f"{rng.choice(words)} {i} {passage} {rng.choice(words)}{i}") for i in range(200)]
    assert found_rows(remove_repeats(frame(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("piece,run", [(1 << 19, 60), (64, 60), (200, 3)])
def test_equal_strings_have_equal_beginnings(monkeypatch, piece, run):
    monkeypatch.setattr(suffix_family, "PIECE", piece)
    monkeypatch.setattr(suffix_family, "RUN", run)
    rng = random.Random(piece)
    texts = [t for _, t in corpus(rng, 30, "abcdé ")] + ["", "a" * 300, "ab" * 100]
    found = suffix_family._suffixes(pa.array(["skipped"] + texts, pa.string()).slice(1))
    key_of, contexts = {}, {}
    stood = set()
    for row, start, n, key, context in zip(*(found[c].tolist() for c in ("row", "start", "n", "key", "context"))):
        assert 0 < n <= run
        data = texts[row].encode()
        strings = [data[start + i : start + i + LENGTH] for i in range(n)]
        assert contexts.setdefault((key, context), strings) == strings
        for i, s in enumerate(strings):
            assert len(s) == LENGTH and key_of.setdefault(s, key) == key
            assert (row, start + i) not in stood
            stood.add((row, start + i))
    assert len(stood) == sum(max(0, len(t.encode()) - LENGTH + 1) for t in texts)


def test_levels_grow_geometrically(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdef") for _ in range(200)) for _ in range(7)]
    family = SuffixFamily(bits=2)
    sizes, removed = [], []
    for i, text in enumerate(texts):
        batch = spark.createDataFrame([(2 * i, 0, text), (2 * i + 1, 0, texts[i // 2] if i else "short")], "id long, tag long, text string")
        found = family.add(batch)
        hits = suffix_family._flat(found[suffix_family.HITS], "id", "n").collect()
        assert {r.id for r in hits} <= {2 * i + 1} and found[suffix_family.UNDECIDED].count() == 0
        removed.append(sum(r.n for r in hits))
        sizes.append([size for size, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    # Every batch but the first repeats an earlier text, with 151 strings.
    assert removed == [0] + [151] * 6
    keys = [k for _, level in family.levels for row in level.collect() for k in suffix_family._opened(row.asDict())["key"].tolist()]
    assert len(keys) == len(set(keys)) == sum(len(set(suffix_family._suffixes(pa.array([t]))["key"])) for t in texts)
    family.drop()


def test_packed_numbers():
    values = np.array([0, 1, -1, 1 << 62, -(1 << 63), 255, 256])
    entries = {f: values >> i for i, f in enumerate(suffix_family.FIELDS)} | {"tag": values * 0}
    row = suffix_family._row(1, 0, entries)
    assert (row["shard"], row["what"], row["n"]) == (1, 0, 7)
    assert all((x == entries[f]).all() for f, x in suffix_family._opened(row).items())


def test_smallest_of_neighbours():
    values = np.random.default_rng(1).integers(0, 1 << 60, 200)
    for width in (1, 2, 3, 8, 27):
        assert suffix_family._smallest(values, width).tolist() == [values[i : i + width].min() for i in range(201 - width)]
