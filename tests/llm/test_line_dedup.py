import random
import re

from pyspark.sql import functions as F

from tallyloom.llm import line_dedup
from tallyloom.llm.line_dedup import remove_passages

CUT = r"(?<=[.!?])(?=[ \t])|(?<=\n)"


def sentence(rng, n=None):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n or rng.randint(6, 14))]
    return " ".join(words).capitalize() + rng.choice(".!?")


def lines(text):
    return [x.strip() for x in re.split(CUT, text or "") if x.strip()]


def plain_result(rows, passages):
    """Texts with every planted passage taken out but at its first place."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        for p in passages:
            if p in text:
                head, *rest = text.split(p)
                text = head + (p if p not in seen else "") + "".join(rest)
                seen.add(p)
        out[doc_id] = text
    return out


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(11)
    passages = [" ".join(sentence(rng) for _ in range(rng.randint(6, 20))) for _ in range(8)]
    rows = []
    for i in range(160):
        parts = [sentence(rng) + rng.choice([" ", "\n"]) + sentence(rng) for _ in range(rng.randint(2, 10))]
        for p in passages:
            if rng.random() < 0.15:
                parts.insert(rng.randrange(len(parts) + 1), p)
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id long, text string, lines string, removed_lines int")
    result = remove_passages(docs)
    assert result.columns == ["doc_id", "text", "lines", "removed_lines", "removed_words"]
    found = {r.doc_id: r for r in result.collect()}
    expected, planted = plain_result(rows, passages), 0
    for i, text in rows:
        planted += text != expected[i]
        assert lines(found[i].text) == lines(expected[i])
        if text == expected[i]:
            assert found[i].text == text and found[i].removed_lines == 0
    assert planted > 50
    for p in passages:
        assert sum(p in r.text for r in found.values()) == 1


def test_every_removed_line_stands_earlier(spark):
    rng = random.Random(12)
    pool = [sentence(rng) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    found = {r.doc_id: r.text for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {x for t in found.values() for x in lines(t)}
    assert left == {x for _, t in rows for x in lines(t)}


def test_edges(spark):
    rng = random.Random(13)
    passage = "\n".join(sentence(rng) for _ in range(12))
    short = " ".join(sentence(rng, 4) for _ in range(3))
    rows = [
        (None, passage), (1, passage), (1, passage), (2, None), (3, ""), (4, " \n "), (5, short), (6, short),
        (7, passage + "\n" + passage), (8, "no end"), (9, "x. " * 30000), (None, None),
    ]
    found = remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r.text)
    assert len(found) == len(rows) and sorted(map(str, by[None])) == sorted(["None", passage])
    assert by[1] == ["", ""] and by[2] == [None] and by[3] == [""] and by[4] == [" \n "]
    assert by[5] == by[6] == [short] and by[7] == [""] and by[8] == ["no end"] and by[9][0].startswith("x. x.")
    assert remove_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_short_lines_go(spark):
    rng = random.Random(14)
    rows, passages = [], [[sentence(rng, 3) for _ in range(40)] for _ in range(6)]
    for i in range(48):
        own = [sentence(rng, 12) for _ in range(6)]
        rows.append((i, "\n".join(own[:3] + passages[i % 6] + own[3:])))
    found = {r.doc_id: r.text for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        own = lines(text)
        assert lines(found[i]) == (own if i < 6 else own[:3] + own[-3:])


def test_passages_of_few_lines_go_whole_whatever_stands_around_them(spark):
    rng = random.Random(15)
    passages = [[sentence(rng, rng.randint(26, 60)) for _ in range(n)] for n in (2, 3, 4, 5) for _ in range(6)]
    # A short line at either end is part of the passage.
    passages += [[sentence(rng, n) for n in sizes] for sizes in ((52, 2), (2, 52), (55, 3, 1), (3, 60, 3), (30, 30, 2, 2))]
    rows = []
    for i in range(4 * len(passages)):
        own = [sentence(rng) for _ in range(6)]
        rows.append((i, " ".join(own[:3] + passages[i % len(passages)] + own[3:])))
    found = {r.doc_id: r.text for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        own = lines(text)
        assert lines(found[i]) == (own if i < len(passages) else own[:3] + own[-3:])


def test_a_passage_of_one_long_line_goes(spark):
    rng = random.Random(16)
    long, short = sentence(rng, 50), sentence(rng, 49)
    # Behind half a sentence the first line of a passage is another one; its rest is a single line.
    rows = [(1, long), (2, f"{sentence(rng)} {long} {sentence(rng)}"), (3, f"cut off {sentence(rng)} {long}"), (4, short), (5, short)]
    found = {r.doc_id: r for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert lines(found[i].text) == [x for x in lines(text) if i == 1 or x != long]
        assert (found[i].removed_lines, found[i].removed_words) == ((1, 50) if i in (2, 3) else (0, 0))


def plain_removed(rows, min_words=50):
    """Numbers of words that go: every run of lines with enough words that stands earlier, found by trying all."""
    cut = {i: lines(t) for i, t in rows}
    first = {}
    runs = lambda own: ((a, b) for a in range(len(own)) for b in range(a + 1, len(own) + 1))
    gone = {i: set() for i in cut}
    for i, own in sorted(cut.items()):
        sizes = [len(x.split()) for x in own]
        for a, b in runs(own):
            if sum(sizes[a:b]) < min_words or (b - a > 1 and sum(sizes[a + 1 : b]) >= min_words and sum(sizes[a : b - 1]) >= min_words):
                continue
            j, c = first.setdefault(tuple(own[a:b]), (i, a))
            if j != i or c + b - a <= a:
                gone[i].update(range(a, b))
    return {i: sum(len(own[k].split()) for k in gone[i]) for i, own in cut.items()}


def test_equals_brute_force_on_random_texts(spark):
    rng = random.Random(17)
    pool = [sentence(rng, rng.choice([1, 2, 5, 9, 20, 60])) for _ in range(120)]
    rows = []
    for i in range(80):
        at, parts = rng.randrange(len(pool)), []
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(pool))
            parts += pool[at : at + rng.randint(1, 30)] if rng.random() < 0.6 else [sentence(rng) for _ in range(5)]
        if i % 9 == 0:
            parts = pool[i : i + 7] * 12
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\n\n", " \n "]) for x in parts)))
    found = {r.doc_id: r.removed_words for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = plain_removed(rows)
    assert found == expected and sum(map(bool, found.values())) > 30


def test_a_user_may_have_any_plain_column_name(spark):
    rng = random.Random(18)
    text = " ".join(sentence(rng) for _ in range(8))
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, text, 5, 6, 7, 8)], "doc_id long, text string, ranges int, own_id int, own_hash int, place int")
    found = remove_passages(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in found] == [(text, 1, 2, 3, 4), ("", 5, 6, 7, 8)]


def test_lines_of_one_hash_and_several_texts_stay(spark, monkeypatch):
    rng = random.Random(19)
    text = [sentence(rng, 12) for _ in range(8)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text)), (3, " ".join(text[:7] + [sentence(rng, 12)]))], "doc_id long, text string")
    runs = line_dedup.repeated_lines(docs)
    assert runs.filter("doc_id = 2").count() > 0 and runs.filter("doc_id = 3").count() > 0
    # A hash of less than three bits lets lines collide.
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.pmod(F.hash(*c), F.lit(4)).cast("long"))
    assert line_dedup.repeated_lines(docs).count() == 0


def test_windows_are_rows_and_equal_a_plain_search(spark):
    """Windows are not worked out inside arrays, and odd blanks don't change the words of a line."""
    texts = [
        "one two three\nfour five\nsix\nseven eight nine ten eleven twelve\n  thirteen\n",
        "a\tb  c\nd \x0b e\n\n f\r\ng h. i j! k\n", "x\n" * 70 + "y z", "few words", "", "   ", None, "one line of words only",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_dedup._windows(line_dedup._lines(docs), 5)
    expected = []
    for i, text in enumerate(texts):
        lines = [n for n in (len(x.split()) for x in re.split(r"\n|(?<=[.!?])\s", text or "")) if n]
        runs = [(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if sum(lines[a : b + 1]) >= 5]
        starts = {min(r for r in runs if r[0] == a) for a in {a for a, _ in runs}}
        ends = {max(r for r in runs if r[1] == b) for b in {b for _, b in runs}}
        expected += [(i, a + 1, b + 1) for a, b in starts | ends]
    assert sorted((r.doc_id, r.first, r.last) for r in found.select("doc_id", "first", "last").collect()) == sorted(expected)


def test_found_lines_are_not_broadcast(spark):
    """Their lists take many times the memory of the file they are stored in."""
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    result = remove_passages(spark.createDataFrame([(1, passage), (2, f"Before. {passage}"), (None, passage)], "doc_id long, text string"))
    assert sorted(r.text for r in result.collect()) == ["", "Before.", passage]
    text = result._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.split("\n") if "Join" in line and "__own_hash" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
