"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

A document is scanned once, whatever the number of items. Words are compared as UTF-8 bytes, each
byte read as one Latin-1 character, so offsets of a hit lead straight back to the original bytes
and from there to code points. Documents are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import by_batches, stored

WORD = re.compile(r"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Text of the items in one automaton; a larger benchmark is scanned for in several passes.
BLOCK_BYTES = 32 << 20
COLUMNS = (
    "n_words long, hits array<struct<first:int,last:int>>, "
    "spans array<struct<start:int,end:int>>, items array<string>"
)


def as_bytes(text: str | None) -> str:
    """Lower-cased A-Z, one character per UTF-8 byte."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("latin-1")


def windows(words: list[str], size: int) -> list[list[str]]:
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[str, str | None]], size: int) -> ahocorasick.Automaton | None:
    """All windows of all items; a window knows its length in words and its items."""
    known: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        for window in windows(WORD.findall(as_bytes(text)), size):
            known.setdefault(f" {' '.join(window)} ", (len(window), set()))[1].add(item)
    if not known:
        return None
    found = ahocorasick.Automaton()
    for window, value in known.items():
        found.add_word(window, value)
    found.make_automaton()
    return found


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of word numbers, both ends included, sorted and joined where they touch."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]], set[str]]:
    """Number of words, ranges of hit words, their spans in code points, and items found."""
    plain = as_bytes(text)
    words = WORD.findall(plain)
    if machine is None or not words:
        return len(words), [], [], set()
    ranges, items, starts = [], set(), None
    for end, (length, own) in machine.iter(f" {' '.join(words)} "):
        if starts is None:
            starts, at = [], 1
            for word in words:
                starts.append(at)
                at += len(word) + 1
        last = bisect_left(starts, end) - 1
        ranges.append((last - length + 1, last))
        items |= own
    if not ranges:
        return len(words), [], [], set()
    hits = _merged(ranges)
    places = [m.span() for m in WORD.finditer(plain)]
    spans, points, seen = [], 0, 0
    for first, last in hits:
        pair = []
        for offset in (places[first][0], places[last][1]):
            points += sum((ord(c) & 0xC0) != 0x80 for c in plain[seen:offset])
            seen = offset
            pair.append(points)
        spans.append((pair[0], pair[1]))
    return len(words), hits, spans, items


_BUILT: dict[str, object] = {}


def _machine(key: str, items, size: int):
    """One automaton per Python worker and block."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(items.value, size)
    return _BUILT[key]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, str | None]]]:
    """Items in blocks of bounded text, read one after the other."""
    known = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = total // block_bytes + 1
    for number in range(count):
        rows = known.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number).collect()
        yield [(r.item or "", r.text) for r in rows]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs with what they share with the benchmark.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A window is
    ``window`` consecutive words of an item; an item of fewer words is one window, and an item
    without words has none. Added columns, replacing such of docs: n_words; hits, ranges of word
    numbers that lie in an occurrence of a window; spans, the same in code points of the original
    text, end exclusive; items, the ids found, as sorted strings; n_hit; contaminated, true if
    n_hit > 0 and 20 * n_hit >= n_words.

    Null texts have no words. Null item ids are written as an empty string; repeated ids count
    once. Repeated rows are scanned alike, an empty table gives an empty result. Only the
    benchmark, in blocks of ``block_bytes``, passes through the driver to the tasks.
    """
    spark = docs.sparkSession
    added = ["n_words", "hits", "spans", "items", "n_hit", "contaminated"]
    kept = [c for c in docs.columns if c.lower() not in added]
    found = None
    for block in _blocks(benchmark, block_bytes):
        items = spark.sparkContext.broadcast(block)
        source = docs.select(*kept) if found is None else stored(found)
        found = _scan_block(source, kept, items, window, found is not None)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def _scan_block(source: DataFrame, kept: list[str], items, size: int, merge: bool) -> DataFrame:
    fields = source.select(*kept).schema
    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    key = f"{items.id if hasattr(items, 'id') else id(items)}-{size}"

    def scan_batch(columns):
        machine = _machine(key, items, size)
        out = {name: columns[name] for name in kept}
        results = [scan(t, machine) for t in columns["text"].to_pylist()]
        if merge:
            earlier = zip(*(columns[c].to_pylist() for c in ("hits", "spans", "items")))
            results = [
                (n, _merged(hits + [(h["first"], h["last"]) for h in a]),
                 _joined(spans + [(s["start"], s["end"]) for s in b]), found | set(c))
                for (n, hits, spans, found), (a, b, c) in zip(results, earlier)
            ]
        out["n_words"] = [r[0] for r in results]
        out["hits"] = [[{"first": a, "last": b} for a, b in r[1]] for r in results]
        out["spans"] = [[{"start": a, "end": b} for a, b in r[2]] for r in results]
        out["items"] = [sorted(r[3]) for r in results]
        return out

    return by_batches(source, scan_batch, names + COLUMNS)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in code points, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out
