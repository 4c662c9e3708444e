"""Removal of repeated passages by content-defined chunks of lines.

A text is cut into lines: at line ends, and after the end of a sentence, so that a passage pasted
into a paragraph has lines of its own. A passage is a run of lines, blank ones left out, that has
enough words and stands as a whole earlier. It holds, from each of its lines, the shortest run of
lines with enough words that starts there, as long as words are left, and up to each of its lines
the shortest such run that ends there. These windows depend on nothing outside the passage, and
together they cover it; so the repeated windows are what has to go.

1. One pass over the texts stores the hash and number of words of every line; windows are worked out
   from these when they are needed. The line with the smallest hash of a window is its anchor. Like
   any choice of the content in a rolling window, anchors don't shift with what stands before, and
   every passage has one.
2. Boundaries are lines told by their hash and number of words, and both ends of a text. A chunk
   reaches from a boundary to the next but one. Chunks that stand earlier go at once.
3. Windows inside one such chunk need no look: the chunk's first occurrence holds them, too. Of the
   others only those are compared whose anchor is an anchor in several places; a bitmap of fixed
   size tells them. This finds the ends of passages, and passages too short for a chunk.
4. Lines are compared byte by byte: where a line hash stands for several texts, among the documents
   that lose something and those they repeat, runs with that hash stay. Runs are equal if hashes of
   all their lines' hashes and the smallest of these, 128 bits together, are.

Every occurrence but the first is repeated; one that overlaps the first in its document is not.
Repeated runs that touch or overlap are one passage. What is left of the text keeps its bytes. The
first occurrence is the one with the smallest doc_id (null smallest) and place; it always stays,
since a line is only removed for an equal line that stands earlier in this order.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import key_bitmap, mark_possible, stored

#: 2**26 bits: 8 MiB to every task. A fuller bitmap only lets more through to the exact steps.
BITS = 26
#: A passage of fewer words stays.
MIN_WORDS = 50
#: Words between two boundaries of chunks, on average.
WORDS_APART = 100
#: Blanks that end a line: all behind the end of a sentence, others if a line end is among them.
ENDS = r"\s(?:(?<=[.!?]\s)|(?<=\n)(?<!\s\s)|(?<!\s\s)[^\S\n]*+\n)\s*+"
#: The places where such blanks begin.
CUT = r"(?=\s)(?:(?<=[.!?])|(?<!\s)(?=[^\S\n]*+\n))"
BLANKS = " \t\r\n\f\v"


def _bare(text) -> Column:
    """A text without blanks at its ends; line ends count as blanks.

    Trimming a set of characters costs a pass over the whole text, which is spared where both ends are printable ASCII.
    """
    text = F.col(text) if isinstance(text, str) else text
    data = text.cast("binary")
    printable = lambda at: F.substring(data, at, 1).between(F.lit(b"!"), F.lit(b"~"))
    return F.when(printable(1) & printable(-1), text).otherwise(F.trim(text, F.lit(BLANKS)))


def _plain(text: str) -> Column:
    """Whether all blanks in the lines of a text are single spaces, told by looking for others in the whole text."""
    others = [F.contains(F.col(text), F.lit(x)) for x in ("  ", *BLANKS.replace(" ", "").replace("\n", ""))]
    return ~reduce(or_, others)


def _words(line: Column, plain: Column) -> Column:
    """Words of a line without blanks at its ends. Single spaces are counted by taking them away, as bytes."""
    blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(plain, blanks + F.least(F.octet_length(line), F.lit(1))).otherwise(F.regexp_count(line, F.lit(r"\S+")))


def _lines(docs: DataFrame) -> DataFrame:
    """Per text: the hashes and word counts of its lines, and bounds, the places of its boundaries, from 1."""
    whole = F.coalesce("text", F.lit(""))
    bare = docs.select("doc_id", F.xxhash64(whole).alias("text_hash"), _once(bare=_bare(whole)))
    lines = bare.select("doc_id", "text_hash", _once(lines=F.split("bare", ENDS), plain=_plain("bare")))
    counted = lines.select("doc_id", "text_hash", _once(
        hashes=F.transform("lines", lambda x: F.xxhash64(x)), counts=F.transform("lines", lambda x: _words(x, F.col("plain"))),
    ))
    # A line is a boundary as likely as it has words.
    bounds = F.expr(
        "concat(array(1), filter(sequence(2, greatest(size(hashes), 2)), "
        f"i -> pmod(get(hashes, i - 1), {WORDS_APART}L) < get(counts, i - 1)), array(size(hashes) + 1))"
    )
    return counted.select("*", bounds.alias("bounds"))


# Below, rows are made before anything is worked out of a run of lines: expressions of rows are
# compiled, functions over the elements of an array are not.


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """One row per window: all columns of the texts, and the window's first and last line, from 1."""
    of = F.flatten(F.transform("counts", lambda n, i: F.array_repeat(i + 1, n)))
    # of has each word's line. A row for the last word of every line, with the place of its first word, from 0.
    ends = (
        lines.select("*", _once(of=of))
        .select("*", F.posexplode("of").alias("k", "line"))
        .filter("k = size(of) - 1 OR get(of, k + 1) <> line")
        .withColumn("q", F.expr("k + 1 - get(counts, line - 1)"))
    )
    # One that ends with the line of words q to k starts in the line of word k - min_words + 1. It is a window from
    # its first line, too, unless it has enough words even without that last line.
    forward = f"if(q + {min_words} <= size(of), struct(line AS first, get(of, q + {min_words - 1}) AS last), NULL)"
    backward = (
        f"if(q >= {min_words} AND get(of, q - {min_words}) = get(of, k - {min_words - 1}), "
        f"struct(get(of, k - {min_words - 1}) AS first, line AS last), NULL)"
    )
    return ends.select(*lines.columns, F.expr(f"inline(array({forward}, {backward}))")).filter("first IS NOT NULL")


def _chunks(lines: DataFrame, min_words: int) -> DataFrame:
    """One row per chunk, as _keyed gives it.

    Chunks have enough words for a window; ends of texts count as boundaries.
    """
    spans = F.expr(
        "transform(slice(bounds, 1, greatest(size(bounds) - 2, 1)), "
        "(a, k) -> struct(a AS first, coalesce(get(bounds, k + 2), get(bounds, k + 1)) - 1 AS last))"
    )
    rows = lines.select("doc_id", "text_hash", "hashes", "counts", F.inline(spans))
    # Every line has a word, unless the text is empty, so only chunks of few lines are added up.
    words = "aggregate(slice(counts, first, last - first + 1), 0L, (s, n) -> s + n)"
    return _keyed(rows.filter(f"last - first >= {min_words} OR {words} >= {min_words}"))


def _keyed(runs: DataFrame) -> DataFrame:
    """Runs of lines with a hash of their lines' hashes, and the smallest of these."""
    rows = runs.withColumn("n", F.expr("last - first + 1"))
    part = F.expr("slice(hashes, first, n)")
    return rows.select("doc_id", "text_hash", "first", "n", F.xxhash64(part).alias("key"), F.array_min(part).alias("least"))


def _anchors(windows: DataFrame) -> DataFrame:
    """The smallest hash of every window's lines, and a hash of its place."""
    part = F.expr("slice(hashes, first, last - first + 1)")
    least = F.array_min(part)
    place = F.xxhash64("doc_id", "text_hash", F.array_position(part, least) + F.col("first"))
    return windows.select(least.alias("anchor"), place.alias("place"))


def _repeats(runs: DataFrame) -> DataFrame:
    """Runs of lines that repeat the first occurrence, with its place, and don't overlap it."""
    firsts = stored(
        runs.groupBy(F.col("key").alias("own_key"), F.col("least").alias("own_least"))
        .agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_hash", "first", "n")).alias("place"))
        .filter("times > 1").drop("times")
    )
    same_text = F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("text_hash") == F.col("place.text_hash"))
    overlaps = same_text & (F.col("first") < F.col("place.first") + F.col("place.n"))
    equal = (F.col("key") == F.col("own_key")) & (F.col("least") == F.col("own_least"))
    return runs.join(firsts, equal & ~overlaps).select("doc_id", "text_hash", "first", "n", "place")


def _once(**columns: Column) -> Column:
    """Columns that are worked out once per row, however often later expressions refer to them.

    The optimizer puts expressions in place of references, even inside functions that run for
    every element of an array, but does not do so across a generator.
    """
    return F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, text_hash, first, n and place: runs of lines (from 1, blank ones left out) that repeat another, at place."""
    lines = stored(_lines(docs))
    places = _anchors(_windows(lines.drop("bounds"), min_words)).groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    several = stored(key_bitmap(places.filter("a <> b"), "anchor", bits))
    chunks = stored(_repeats(stored(_chunks(lines, min_words))))
    # A group holds the chunks of one document, so it is bounded by the document.
    covered = chunks.groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(
        F.array_sort(F.collect_set(F.struct("first", "n"))).alias("gone")
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    # For every line the end of the last such chunk that starts there or before.
    upto = F.expr(
        "flatten(concat(array(array_repeat(0, gone[0].first - 1)), transform(gone, (r, i) -> array_repeat("
        "r.first + r.n - 1, coalesce(get(gone, i + 1).first, size(hashes) + 1) - r.first))))"
    )
    # Only texts that may have lost chunks are moved to them.
    marked = mark_possible(lines, "text_hash", stored(key_bitmap(chunks, "text_hash", bits)), bits, "possible")
    whole = ["doc_id", "text_hash", "hashes", "counts"]
    left = marked.filter("possible").join(covered, same, "left").select(*whole, _once(upto=upto)).union(
        marked.filter("NOT possible").select(*whole, F.lit(None).cast("array<int>").alias("upto"))
    )
    windows = _keyed(_windows(left, min_words).filter("upto IS NULL OR last > get(upto, first - 1)"))
    candidates = stored(mark_possible(windows, "least", several, bits, "possible").filter("possible").drop("possible"))
    return _same_bytes(docs, lines, stored(chunks.union(_repeats(candidates))), bits)


def _same_bytes(docs: DataFrame, lines: DataFrame, runs: DataFrame, bits: int) -> DataFrame:
    """The runs without those that hold a line whose hash stands for several texts.

    Compared are the bytes of all lines of the texts that lose runs or have the first occurrence.
    """
    ends = stored(key_bitmap(runs.select("text_hash").union(runs.select("place.text_hash")), "text_hash", bits))
    whole = F.coalesce("text", F.lit(""))
    hashed = docs.select(whole.alias("text"), F.xxhash64(whole).alias("text_hash"))
    texts = mark_possible(hashed, "text_hash", ends, bits, "possible").filter("possible")
    each = texts.select(F.explode(F.split(_bare("text"), ENDS)).alias("line")).select(F.xxhash64("line").alias("hash"), "line")
    several = stored(each.groupBy("hash").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b").select("hash"))
    if several.isEmpty():
        return runs
    at = lines.select("doc_id", "text_hash", F.posexplode("hashes").alias("i", "hash")).join(several, "hash", "left_semi")
    # A group holds lines of one document, so it is bounded by the document.
    doubtful = at.groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(
        F.collect_set(F.col("i") + 1).alias("doubtful")
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    inside = F.exists(F.coalesce("doubtful", F.array().cast("array<int>")), lambda i: (i >= F.col("first")) & (i < F.col("first") + F.col("n")))
    return runs.join(doubtful, same, "left").filter(~inside).select(*runs.columns)


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = BITS) -> DataFrame:
    """All columns of docs, the text without its repeated passages, and removed_lines, removed_words.

    Lines are compared without blanks at their ends, and blank lines are passed over. A passage is
    a run of one or more lines and at least ``min_words`` words that stands earlier as a whole. A text
    without such a passage keeps every byte, and null stays null; one that loses a passage loses the
    blanks at its ends, too, and becomes empty if there is nothing else. Rows that
    repeat a doc_id and a text are one document and lose the same passages. Repetitions within a
    document count. Columns of docs named removed_lines or removed_words are replaced, names with two
    leading underscores are kept for the work; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("removed_lines", "removed_words")]
    runs_found = stored(repeated_lines(docs.select("doc_id", "text"), min_words, bits))
    # A group holds the runs of one document, so it is bounded by the document.
    found = stored(
        runs_found.groupBy(F.col("doc_id").alias("__own_id"), F.col("text_hash").alias("__own_hash"))
        .agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("__found"))
    )
    # Only texts that may lose lines are moved to what was found in them.
    hashed = docs.select(*kept, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"))
    bitmap = stored(key_bitmap(found, "__own_hash", bits))
    marked = mark_possible(hashed, "__hash", bitmap, bits, "__possible")
    # Merged, as lists of small numbers take many times the memory of their file, by which Spark would broadcast them.
    joined = marked.filter("__possible").join(
        found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__own_id")) & (F.col("__hash") == F.col("__own_hash")), "left"
    )
    # The numbers of the lines that go, each once.
    # Of a run that the next one, which starts no earlier, reaches beyond only what stands before that is written out.
    upto = (
        "if(coalesce(get(__found, i + 1).first + get(__found, i + 1).n, 0) < r.first + r.n, r.first + r.n - 1, "
        "greatest(r.first, least(r.first + r.n, get(__found, i + 1).first) - 1))"
    )
    gone = F.expr(f"array_sort(array_distinct(flatten(transform(__found, (r, i) -> sequence(r.first, {upto})))))")
    split = F.when(F.col("__found").isNotNull(), F.split(_bare("text"), CUT))
    split = joined.select(*kept, _once(__lines=split, __gone=gone))
    firsts = F.expr("filter(__gone, (x, i) -> i = 0 OR get(__gone, i - 1) < x - 1)")
    lasts = F.expr("filter(__gone, (x, i) -> i = size(__gone) - 1 OR get(__gone, i + 1) > x + 1)")
    split = split.select(*kept, "__lines", _once(__firsts=firsts, __lasts=lasts))

    def passage(a, b):
        words = F.regexp_count(F.array_join(F.slice("__lines", a, b - a + 1), ""), F.lit(r"\S+"))
        return F.struct(a.alias("a"), b.alias("b"), words.alias("w"))

    changed = split.select(*kept, "__lines", _once(__passages=F.zip_with("__firsts", "__lasts", passage)))
    # What stands before each passage, and behind the last one.
    left = F.expr(
        "concat(array_join(transform(__passages, (r, i) -> array_join(slice(__lines, "
        "coalesce(get(__passages, i - 1).b, 0) + 1, r.a - 1 - coalesce(get(__passages, i - 1).b, 0)), '')), ''), "
        "array_join(slice(__lines, element_at(__passages, -1).b + 1, size(__lines)), ''))"
    )
    touched = F.size("__passages") > 0
    result = F.when(touched, _bare(left)).otherwise(F.col("text"))
    rest = [c for c in kept if c != "text"]
    counted = {
        "removed_lines": F.when(touched, F.expr("aggregate(__passages, 0L, (s, r) -> s + r.b - r.a + 1)")).otherwise(0),
        "removed_words": F.when(touched, F.expr("aggregate(__passages, 0L, (s, r) -> s + r.w)")).otherwise(0),
    }
    done = changed.select(*rest, _once(text=result, **counted))
    none = {name: F.lit(0).cast("long").alias(name) for name in counted}
    return done.select(*kept, *counted).union(marked.filter("NOT __possible").select(*kept, *none.values()))
