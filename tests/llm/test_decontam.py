import random
import re

from tallyloom.llm.decontam import find_benchmark

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text, items, size):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, content in items:
        own = WORD.findall(lower(content))
        for i in range(max(1, len(own) - size + 1) if own else 0):
            w = own[i : i + size]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def fixture(seed=5):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cé", "漢字", "x1", "the", "Of"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, rng.choice([" ", ", ", "\n- "]).join(make(rng.choice([0, 1, 3, 13, 14, 30])))) for i in range(12)]
    items += [(3, items[4][1]), (None, "q r s"), (50, None), (51, "!!!")]
    texts = [None, "", "...", "one", "q R S", "qq r s"]
    for _ in range(60):
        words = make(rng.randint(1, 60))
        if rng.random() < 0.6:
            words[rng.randrange(len(words)) : 0] = (rng.choice(items)[1] or "").split()
        texts.append(rng.choice(["; ", " ", "_"]).join(words))
    return items, texts


def test_hits_equal_plain_search(spark):
    items, texts = fixture()
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(0, texts[9], "n"), (None, texts[10], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for size, block in ((13, 1 << 20), (4, 300)):
        found = find_benchmark(docs, benchmark, size, block)
        assert found.columns == ["doc_id", "text", "n_words", "hits", "spans", "items", "n_hit", "contaminated"]
        rows_found = found.collect()
        assert len(rows_found) == len(rows) and any(r.contaminated for r in rows_found)
        for r in rows_found:
            assert (r.n_words, r.n_hit, r["items"]) == plain(r.text, items, size)
            assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
            words = [m.span() for m in WORD.finditer(lower(r.text))]
            inside = {i for i, (a, b) in enumerate(words) if any(s.start <= a and b <= s.end for s in r.spans)}
            assert inside == {i for h in r.hits for i in range(h["first"], h["last"] + 1)}


def test_long_texts_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "pad " * 200_000 + item)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    (row,) = find_benchmark(docs, benchmark).collect()
    assert row.n_hit == 20 and not row.contaminated and row.text[row.spans[0].start :] == item
    assert find_benchmark(docs.limit(0), benchmark).count() == 0
    assert find_benchmark(docs, benchmark.limit(0)).first().n_hit == 0
