"""Spelling variants of words, found in a frequency-vector trie.

Letters fall into groups, and a word's vector holds how often it has a letter of each group. One
inserted, deleted or replaced letter changes the vector by a surplus of at most one and a deficit
of at most one. Words are arranged in a trie by their successive counts, and a search goes down
from the root along counts that are equal, one too many or one too few, as long as its budget of
one surplus and one deficit lasts. Words at the leaves it reaches are verified letter by letter.

The upper levels of the trie are Spark tables: a block is a node of level ``UPPER_LEVELS``, and a
join of blocks tells which blocks a search from another block can reach with what budget left. The
lower levels are searched in tasks: one takes a chunk of a block's words and a slice of the words
that search it, both of bounded size, however many words share a block. The search is depth-first
over sets of words that are at the same node with the same budget. The relation is symmetric, so a
pair is looked for from one side only: by blocks, and by words inside one block.

No pair leaves a task: it returns per word the number of near words and the best one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import lowered, stored

MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: One run in so many is written with a letter left out.
DAMAGE = 199
#: A letter's group is its code point modulo 16. Levels of the trie, telling groups first.
GROUPS = 16
LEVELS = (5, 9, 14, 1, 4, 2, 3, 15, 12, 13, 0, 8, 7, 6, 10, 11)
UPPER_LEVELS = 4
#: Words of a block, words that search it, and pairs or trie steps taken at a time in one task.
CHUNK, SLICE, STEP = 1 << 15, 1 << 16, 1 << 18
#: Words up to this length are verified side by side, longer ones each by itself.
WIDTH = 64
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word and n of all words with enough letters and occurrences.

    Words are the longest runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. If the
    crc32 h of ``<doc_id>:<run>`` is divisible by ``damage``, the letter at h modulo the length is
    left out. A null id counts as an empty one; null and empty texts have no words.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered("text"), F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run"),
    )
    digest = F.crc32(F.concat("id", F.lit(":"), "run"))
    place = (digest % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.select(F.when(digest % damage == 0, without).otherwise(F.col("run")).alias("word"))
    return (
        words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    )


def _upper_path(levels: int) -> Column:
    """The counts of the first groups, from the root."""

    def count(group: int) -> Column:
        members = "".join(x for x in LETTERS if ord(x) % GROUPS == group)
        return F.length("word") - F.length(F.translate("word", members, ""))

    return F.array(*(count(g).cast("int") for g in LEVELS[:levels]))


def _moves(levels: int) -> list[tuple[tuple[int, ...], int, int]]:
    """All changes of the first counts within the budget, with the surplus and the deficit spent."""
    found = []
    for up, down in itertools.product(range(-1, levels), repeat=2):
        if up == down and up >= 0:
            continue
        change = [0] * levels
        if up >= 0:
            change[up] += 1
        if down >= 0:
            change[down] -= 1
        found.append((tuple(change), int(up >= 0), int(down >= 0)))
    return found


def _reach(blocks: DataFrame, levels: int) -> DataFrame:
    """source, path (a block it can reach, not before it), up and down (budget spent), and both sizes."""
    moves = F.array(*(
        F.struct(F.array(*map(F.lit, c)).alias("by"), F.lit(u).alias("up"), F.lit(d).alias("down")) for c, u, d in _moves(levels)
    ))
    steps = blocks.select(F.col("path").alias("source"), F.col("size").alias("searching"), F.explode(moves).alias("m")).select(
        "source", "searching", "m.up", "m.down", F.zip_with("source", "m.by", lambda a, b: a + b).alias("path")
    )
    return steps.filter("path >= source").join(blocks, "path")


class _Trie:
    """Words arranged by the counts of their lower levels."""

    def __init__(self, counts: np.ndarray):
        leaves, of = np.unique(counts, axis=0, return_inverse=True)
        of = of.reshape(-1)
        self.order = np.argsort(of, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(leaves)))))
        # Of every level the nodes, as parent and count; leaves are sorted, and so are these.
        self.levels = []
        parent = np.zeros(len(leaves), dtype=np.int64)
        for level in range(counts.shape[1]):
            key = (parent << 32) + leaves[:, level]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            self.levels.append(key[first])
            parent = np.cumsum(first) - 1

    def search(self, counts: np.ndarray, up: np.ndarray, down: np.ndarray):
        """Arrays of a searching word and a word at a leaf it reaches; depth first, in pieces of bounded size."""
        stack = [(0, np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64), up, down)]
        while stack:
            level, q, node, up, down = stack.pop()
            if len(q) > STEP:
                stack += [(level, *(x[i : i + STEP] for x in (q, node, up, down))) for i in range(0, len(q), STEP)]
                continue
            if level == len(self.levels):
                yield from self._leaves(q, node)
                continue
            nodes, wanted = self.levels[level], (node << 32) + counts[q, level]
            for by, allowed in ((0, slice(None)), (1, up == 0), (-1, (down == 0) & (counts[q, level] > 0))):
                rows, key = q[allowed], wanted[allowed] + by
                at = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
                hit = nodes[at] == key
                if hit.any():
                    u, d = up[allowed][hit] + (by == 1), down[allowed][hit] + (by == -1)
                    stack.append((level + 1, rows[hit], at[hit], u, d))

    def _leaves(self, q, leaf):
        size = self.starts[leaf + 1] - self.starts[leaf]
        ends = np.cumsum(size)
        done = 0
        while done < len(q):
            base = ends[done - 1] if done else 0
            # At least one leaf, which holds no more words than the chunk.
            last = max(done + 1, int(np.searchsorted(ends, base + STEP, side="right")))
            n = size[done:last]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(q[done:last], n), self.order[np.repeat(self.starts[leaf[done:last]], n) + inside]
            done = last


def near(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short) if a[-1 - i] != b[-1 - i]), short)
    return head + tail >= max(len(a), len(b)) - 1


class _Words:
    """Words as bytes, one a letter, with what search and verification need of them."""

    def __init__(self, words: list[str]):
        self.words = [w.encode("latin-1") for w in words]
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        letters = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        cell = np.repeat(np.arange(len(words)) * GROUPS, self.length) + letters % GROUPS
        counts = np.bincount(cell, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
        self.counts = counts[:, LEVELS].astype(np.int64)
        width = int(min(WIDTH, self.length.max(initial=1)))
        table = lambda parts: np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(len(words), width)
        self.head = table(w[:width].ljust(width, b"\0") for w in self.words)
        self.tail = table(w[-width:].rjust(width, b"\0")[::-1] for w in self.words)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of words are near; their lengths differ by one at most."""

        def same(table):
            differs = table[a] != table[b]
            return np.where(differs.any(axis=1), differs.argmax(axis=1), WIDTH + 1)

        head, tail, longest = same(self.head), same(self.tail), np.maximum(self.length[a], self.length[b])
        found = (head <= WIDTH) & (head + tail >= longest - 1)
        for i in np.flatnonzero(longest > WIDTH):
            found[i] = near(self.words[a[i]], self.words[b[i]])
        return found


def _search_chunk(part: pa.Table) -> pa.Table:
    """Per word of a chunk or slice that has near words there: their number and the best one."""
    words, n = part["word"].to_pylist(), part["n"].to_numpy()
    searching = part["searching"].to_numpy()
    both = _Words(words)
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=both.words.__getitem__)] = np.arange(len(words))
    q, w = np.flatnonzero(searching), np.flatnonzero(~searching)
    own, other = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if len(q) and len(w):
        upper = UPPER_LEVELS
        up, down = (part[c].to_numpy()[q].astype(np.int64) for c in ("up", "down"))
        inside = part["inside"].to_numpy()
        for i, j in _Trie(both.counts[w][:, upper:]).search(both.counts[q][:, upper:], up, down):
            i, j = q[i], w[j]
            once = ~inside[i] | (rank[i] < rank[j])
            i, j = i[once], j[once]
            hit = both.near(i, j)
            own += [i[hit], j[hit]]
            other += [j[hit], i[hit]]
    own, other = np.concatenate(own), np.concatenate(other)
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else own
    return pa.table({
        "word": pa.array([words[i] for i in own[first]], pa.string()),
        "n_near": pa.array(np.diff(np.concatenate((first, [len(own)]))), pa.int64()),
        "best_n": pa.array(n[other[first]], pa.int64()),
        "best": pa.array([words[i] for i in other[first]], pa.string()),
    })


def near_words(vocabulary: DataFrame, chunk: int = CHUNK, slice_: int = SLICE) -> DataFrame:
    """word, n_near, best_n and best of every word (columns word, n; words distinct) that has a near word.

    Best is the near word with the largest n, of several the smallest in code-point order.
    """
    words = stored(vocabulary.select("word", "n", _upper_path(UPPER_LEVELS).alias("path")))
    blocks = stored(words.groupBy("path").agg(F.count("*").alias("size")))
    reach = _reach(blocks, UPPER_LEVELS)
    load = reach.groupBy("path").agg(F.sum("searching").alias("load"), F.first("size").alias("size"))
    sizes = load.select(
        "path", F.ceil(F.col("size") / chunk).cast("int").alias("chunks"), F.ceil(F.col("load") / slice_).cast("int").alias("slices")
    )
    routes = stored(reach.join(sizes, "path").select("source", "path", "up", "down", "chunks", "slices"))
    pick = lambda seed, parts: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    in_trie = words.join(routes.filter("source = path AND up = 0 AND down = 0").drop("source"), "path").select(
        "word", "n", F.lit(False).alias("searching"), F.lit(0).alias("up"), F.lit(0).alias("down"), F.lit(False).alias("inside"),
        "path", pick(1, "chunks").alias("chunk"), every("slices").alias("slice"),
    )
    searching = words.withColumnRenamed("path", "source").join(routes, "source").select(
        "word", "n", F.lit(True).alias("searching"), "up", "down", (F.col("source") == F.col("path")).alias("inside"),
        "path", every("chunks").alias("chunk"), pick(2, "slices").alias("slice"),
    )
    found = in_trie.unionByName(searching).groupBy("path", "chunk", "slice").applyInArrow(
        _search_chunk, "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word and root from word and form: forms are followed by doubling the steps.

    n grows by the factor at every step, so a chain of forms is at most log(n) words long.
    """
    current = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        moved = stored(current.join(ahead, F.col("root") == F.col("__at"), "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")
        ))
        current = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return current


def word_forms(vocabulary: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a vocabulary (columns word, n).

    Words are distinct and consist of a-z and U+00C0 to U+00FF. A word's form is its near word of
    largest n (ties: smallest in code-point order) if that is at least ``factor`` times the word's
    own, else null; root is the last word that forms lead to, the word itself without a form. An
    empty vocabulary gives an empty result; other columns are passed over.
    """
    found = stored(
        vocabulary.select("word", "n").join(near_words(vocabulary), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")).alias("form"),
            F.when(F.col("best_n") >= factor * F.col("n"), F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(found.filter(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
