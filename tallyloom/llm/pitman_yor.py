"""Language-model scores of a hierarchical Pitman-Yor model.

Restaurants: one context restaurant for each of the most frequent words as previous word, one for
all other previous words and one for the beginning of a text. They share one parent, the
restaurant of single words, whose own parent is uniform over the vocabulary and one unknown word.

The training counts are grouped by word, a row holding the word's counts in at most CONTEXTS + 2
restaurants. Seating a word's customers needs, besides its own row, only the number of tables of
each restaurant, so a Gibbs sweep is one pass over the rows that reads these totals, a few hundred
numbers, as the previous sweep left them: restaurants are resampled side by side, which is the usual
distributed form of the sampler. Predictive probabilities are averaged over several sweeps.

Scores of the most frequent words come from a table sent to all tasks, HEAD words by at most
CONTEXTS + 2 contexts; all other words are joined with the model by the word itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import remainder, slices, stored

CONTEXTS, HEAD = 126, 1 << 15
BURN_IN, SAMPLES = 2, 3
STRENGTH, PARENT_STRENGTH = 10.0, 10.0
#: Customers of a word seated one by one; the rest are seated in blocks of a quarter more each.
SINGLE = 16
#: Words a task counts before it hands its counts on.
LOCAL_WORDS, TOP_LOCAL = 200_000, 2_000
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and the end of the text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


@dataclass
class Contexts:
    """Numbers of the context restaurants: frequent words, all others, beginning of a text."""

    numbers: dict[bytes, int]

    @property
    def other(self) -> int:
        return len(self.numbers)

    @property
    def start(self) -> int:
        return len(self.numbers) + 1

    def __len__(self) -> int:
        return len(self.numbers) + 2


def frequent_words(texts: DataFrame, limit: int) -> Contexts:
    """The words most frequent by what every task reports of its own most frequent ones."""

    def run(batches):
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text)[:-1])
            if len(counts) > LOCAL_WORDS:
                counts = Counter(dict(counts.most_common(LOCAL_WORDS // 2)))
        top = counts.most_common(TOP_LOCAL)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"]
        )

    top = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = top.orderBy(F.desc("n"), "word").limit(limit).collect()
    return Contexts({bytes(r.word): i for i, r in enumerate(rows)})


def pair_counts(texts: DataFrame, contexts: Contexts) -> DataFrame:
    """word and its counts by context, as the arrays ctx and c in the order of ctx."""
    n_contexts, numbers = len(contexts), contexts.numbers
    other, start = contexts.other, contexts.start

    def run(batches):
        ids: dict[bytes, int] = {}
        own_context: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merge():
            codes = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            unique, inverse = np.unique(codes, return_inverse=True)
            parts[:] = [(unique, np.bincount(inverse, weights=counts).astype(np.int64))]

        def flush():
            merge()
            (codes, counts), words = parts[0], pa.array(list(ids), pa.binary())
            for at in range(0, len(codes), 100_000):
                part = codes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(part // n_contexts)), pa.array((part % n_contexts).astype(np.int32)),
                     pa.array(counts[at : at + 100_000])],
                    names=["word", "ctx", "n"],
                )
            ids.clear(), own_context.clear(), parts.clear()

        for batch in slices(batches):
            seen, codes = [], []
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                for w in words:
                    if w not in ids:
                        ids[w] = len(ids)
                        own_context.append(numbers.get(w, other))
                seen.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            table = np.array(own_context, dtype=np.int64)
            for own in seen:
                before = np.empty(len(own), dtype=np.int64)
                before[0], before[1:] = start, table[own[:-1]]
                codes.append(own * n_contexts + before)
            if codes:
                parts.append(np.unique(np.concatenate(codes), return_counts=True))
            if len(ids) > LOCAL_WORDS:
                yield from flush()
            elif len(parts) > 16:
                merge()
        if parts:
            yield from flush()

    pairs = texts.mapInArrow(run, "word binary, ctx int, n long").groupBy("word", "ctx").agg(F.sum("n").alias("n"))
    # A group holds one word's restaurants, of which there are few.
    rows = pairs.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("ctx", "n"))).alias("own"))
    return rows.select("word", F.col("own.ctx").alias("ctx"), F.col("own.n").alias("c"))


def seat(count: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """Tables of a word after its customers have sat down again.

    count: its customers; others: tables of other words in the restaurant; parent: the word's
    probability in the parent restaurant.
    """
    tables = np.ones(len(count))
    for i in range(1, SINGLE):
        rest = np.flatnonzero(count > i)
        if not len(rest):
            return tables
        t = tables[rest]
        new = (strength + discount * (others[rest] + t)) * parent[rest]
        tables[rest] += rng.random(len(rest)) * (new + i - discount * t) < new
    done = np.minimum(count, SINGLE).astype(float)
    rest = np.flatnonzero(count > SINGLE)
    while len(rest):
        t, i = tables[rest], done[rest]
        upto = np.minimum(np.ceil(i * 1.25), count[rest])
        new = (strength + discount * (others[rest] + t)) * parent[rest]
        expected = new * np.log((upto - discount * t + new) / (i - discount * t + new))
        tables[rest] = np.minimum(t + rng.poisson(np.maximum(expected, 0)), upto)
        done[rest] = upto
        rest = rest[upto < count[rest]]
    return tables


@dataclass
class Totals:
    """What the restaurants know of each other: customers and tables of all of them."""

    customers: np.ndarray
    tables: np.ndarray
    parent_tables: float
    discount: float
    parent_discount: float
    vocabulary: int

    @property
    def parent_customers(self) -> float:
        return float(self.tables.sum())

    def parent_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of words with so many customers and tables in the parent restaurant."""
        backing = (PARENT_STRENGTH + self.parent_discount * self.parent_tables) / (self.vocabulary + 1)
        return (customers - self.parent_discount * tables + backing) / (PARENT_STRENGTH + self.parent_customers)

    def backing(self) -> np.ndarray:
        """Share of probability that each context leaves to the parent."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)


def _discount(n1: float, n2: float) -> float:
    """From the number of things seen once and twice."""
    return float(np.clip(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05, 0.95))


def _lists(batch: pa.RecordBatch, *names: str):
    """Flat numpy values of list columns of equal lengths, and for each value its row."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    sizes = np.diff(columns[0].offsets.to_numpy())
    return [c.flatten().to_numpy(zero_copy_only=False) for c in columns], np.repeat(np.arange(batch.num_rows), sizes), columns[0].offsets


ROWS = "word binary, ctx array<int>, c array<long>, t array<long>, r long, p array<double>, parent array<double>"


def _pass(rows: DataFrame, totals: Totals, number: int, sample: bool, reseat: bool) -> DataFrame:
    """One pass over all words, whose tables and the totals are those of the same sweep.

    ``sample`` adds the predictive probabilities of that sweep to p and to parent; ``reseat`` then
    seats all customers anew. t has a word's tables by context, r its tables in the parent.
    """
    kind = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(),
            pa.list_(pa.float64()), pa.list_(pa.float64()))
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            (ctx, c, t, p), row, offsets = _lists(batch, "ctx", "c", "t", "p")
            word, ctxs, cs, _, r, _, parents = batch.columns
            t, r = t.astype(float), r.to_numpy(zero_copy_only=False).astype(float)
            customers = np.bincount(row, weights=t, minlength=n)
            parent = totals.parent_probability(customers, r)
            if sample:
                share = (c - totals.discount * t) / (STRENGTH + totals.customers[ctx])
                p = p + share + totals.backing()[ctx] * parent[row]
                before = parents.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                after = np.column_stack((before, parent))
                ends = np.arange(n + 1, dtype=np.int32) * after.shape[1]
                parents = pa.ListArray.from_arrays(pa.array(ends), pa.array(after.ravel()))
            if reseat:
                rng = np.random.default_rng([number, zlib.crc32(word[0].as_py() + word[n - 1].as_py())])
                t = seat(c, totals.tables[ctx] - t, parent[row], totals.discount, STRENGTH, rng)
                customers = np.bincount(row, weights=t, minlength=n)
                uniform = np.full(n, 1 / (totals.vocabulary + 1))
                r = seat(customers, totals.parent_tables - r, uniform, totals.parent_discount, PARENT_STRENGTH, rng)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (t.astype(np.int64), np.asarray(p, float))]
            columns = (word, ctxs, cs, lists[0], pa.array(r.astype(np.int64)), lists[1], parents)
            yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(columns, kind)], names=names)

    return stored(rows.mapInArrow(run, ROWS))


def _totals(rows: DataFrame, n_contexts: int, discounts: tuple[float, float], vocabulary: int) -> Totals:
    """Customers and tables of every restaurant, summed over all words."""
    each = rows.select(F.explode(F.arrays_zip("ctx", "c", "t")).alias("x")).groupBy("x.ctx")
    customers, tables = np.zeros(n_contexts), np.zeros(n_contexts)
    for r in each.agg(F.sum("x.c").alias("c"), F.sum("x.t").alias("t")).collect():
        customers[r.ctx], tables[r.ctx] = r.c, r.t
    parent = rows.agg(F.sum("r")).first()[0] or 0
    return Totals(customers, tables, float(parent), *discounts, vocabulary)


@dataclass
class Model:
    contexts: Contexts
    words: DataFrame
    backing: np.ndarray
    unknown: np.ndarray
    n_tokens: int
    vocabulary: int


def train(docs: DataFrame, contexts: int = CONTEXTS, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Learn from the texts of docs. model.words has a row per word: word, n, ctx, p and parent.

    p is the averaged probability in the contexts of ctx; parent has the word's probability in the
    parent restaurant for each sample, from which follows its probability in any other context.
    """
    texts = docs.select("text")
    known = frequent_words(texts, contexts)
    counted = stored(pair_counts(texts, known))
    size = len(known)
    rows = counted.select(
        "word", "ctx", "c", F.transform("c", lambda x: F.lit(1).cast("long")).alias("t"), F.lit(1).cast("long").alias("r"),
        F.transform("c", lambda x: F.lit(0.0)).alias("p"), F.array().cast("array<double>").alias("parent"),
    )
    total = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x)
    seen = lambda k: F.sum(F.size(F.filter("c", lambda x: x == k)))
    shape = counted.agg(
        F.count("*").alias("v"), F.sum(total).alias("n"), seen(1).alias("n1"), seen(2).alias("n2"),
        F.count_if(F.size("ctx") == 1).alias("m1"), F.count_if(F.size("ctx") == 2).alias("m2"),
    ).first()
    vocabulary, n_tokens = shape.v, shape.n or 0
    discounts = _discount(shape.n1 or 0, shape.n2 or 0), _discount(shape.m1 or 0, shape.m2 or 0)
    totals = _totals(rows, size, discounts, vocabulary)
    history = []
    for number in range(burn_in + samples):
        rows = _pass(rows, totals, number, sample=number > burn_in, reseat=True)
        totals = _totals(rows, size, discounts, vocabulary)
        if number >= burn_in:
            history.append(totals)
    words = _pass(rows, totals, burn_in + samples, sample=True, reseat=False)
    count = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x)
    words = words.select("word", count.alias("n"), "ctx", F.transform("p", lambda x: x / samples).alias("p"), "parent")
    unknown = np.array([t.parent_probability(np.zeros(1), np.zeros(1))[0] for t in history])
    return Model(known, words, np.stack([t.backing() for t in history]), unknown, n_tokens, vocabulary)


def _head(model: Model, size: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers, log10 probabilities by context, and counts of the most frequent words and the end."""
    top = model.words.orderBy((F.length("word") == 0).desc(), F.desc("n"), "word").limit(size).toArrow()
    names = top.column("word").to_pylist()
    parent = np.array(top.column("parent").to_pylist()).reshape(len(names), len(model.unknown))
    table = (parent @ model.backing / max(len(model.backing), 1)) if names else np.zeros((0, len(model.contexts)))
    for i, (ctx, p) in enumerate(zip(top.column("ctx").to_pylist(), top.column("p").to_pylist())):
        table[i, ctx] = p
    counts = top.column("n").to_numpy()
    return {w: i for i, w in enumerate(names)}, np.log10(table).astype(np.float32), counts


def score(docs: DataFrame, model: Model, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of docs.

    score is the log10 probability of the tokens, words and the end, under the model; base_score
    that of single words by add-one counts. Null counts as empty: one token, the end. Repeated
    rows get the same scores, whatever their ids; other columns are ignored; an empty table gives
    an empty result. Without training texts every probability is that of the uniform parent.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((*_head(model, head), model.contexts))
    denominator = model.n_tokens + model.vocabulary + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_contexts = len(model.contexts)

    def run(batches):
        numbers, table, counts, contexts = sent.value
        context_of = np.full(len(numbers) + 1, contexts.other, dtype=np.int64)
        for word, i in contexts.numbers.items():
            if word in numbers:
                context_of[numbers[word]] = i
        # Context words outside the head; none unless the head is very small.
        strays = {w: i for w, i in contexts.numbers.items() if w not in numbers}
        base = np.log10((counts + 1) / denominator)
        task, at = TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches):
            out = {c: [] for c in ("row", "n_tokens", "head_known", "head_base", "head_score")}
            rare_words, rare_contexts, rare_times, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                own = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))
                found = own >= 0
                unlisted = np.flatnonzero(~found)
                follows = context_of[own]
                if strays:
                    follows[unlisted] = [strays.get(words[i], contexts.other) for i in unlisted]
                before = np.empty(len(own), dtype=np.int64)
                before[0], before[1:] = contexts.start, follows[:-1]
                rare = Counter(zip([words[i] for i in unlisted], before[unlisted].tolist()))
                rare_words += [w for w, _ in rare]
                rare_contexts += [c for _, c in rare]
                rare_times += rare.values()
                ends.append(len(rare_words))
                out["row"].append(task + at)
                at += 1
                out["n_tokens"].append(len(words))
                out["head_known"].append(int(found.sum()))
                out["head_base"].append(float(base[own[found]].sum()))
                out["head_score"].append(float(table[own[found], before[found]].sum(dtype=float)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            rare = pa.StructArray.from_arrays(
                [pa.array(rare_words, pa.binary()), pa.array(rare_contexts, pa.int32()), pa.array(rare_times, pa.int64())],
                names=["word", "ctx", "times"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, type=t) for v, t in zip(out.values(), types)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)],
                names=["doc_id", *out, "rare"],
            )

    read = stored(docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, row long, n_tokens long, head_known long, head_base double, head_score double, "
        "rare array<struct<word:binary,ctx:int,times:long>>",
    ))
    backing = F.array(*(F.array(*(F.lit(float(x)) for x in one)) for one in model.backing.T)) if n_contexts else None
    rare = read.select("row", F.inline("rare"))
    samples = len(model.unknown)
    shares = F.get(backing, F.col("ctx"))
    parent = F.coalesce("parent", F.array(*(F.lit(float(x)) for x in model.unknown)))
    unseen = F.aggregate(F.zip_with(shares, parent, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / samples
    place = F.array_position("own", F.col("ctx")).cast("int")
    p = F.when(place > 0, F.get("p", place - 1)).otherwise(unseen)
    joined = rare.join(model.words.withColumnRenamed("ctx", "own"), "word", "left")
    sums = joined.groupBy(F.col("row").alias("own_row")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / denominator)).alias("rare_base"),
        F.sum(F.col("times") * F.log10(p)).alias("rare_score"),
    )
    return read.join(sums, F.col("row") == F.col("own_row"), "left").select(
        "doc_id", "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("head_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def held_out(doc_id: str = "doc_id"):
    """Rows that are not learned from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(remainder(doc_id, 7) == 2, F.lit(False))
