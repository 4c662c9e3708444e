"""Language-model scores of a hierarchical Pitman-Yor model with a restaurant for every previous word.

The restaurants are those of ``pitman_yor``, but no previous words share one: each word of the
training texts has its own, whatever its frequency, and so has the beginning of a text. A pair is
written as one key: previous word, blank, word. Words hold no blanks, and neither the beginning, as
a previous word, nor the end, as a word, has a letter.

A single customer sits at one table, so only pairs that occur twice or more are ever seated anew.
The state is three stored tables: these pairs with their tables, the contexts with theirs, and the
words with their customers and tables in the parent. A Gibbs sweep joins the pairs with the
contexts and words of the sweep before, seats them, and adds their tables up again.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.pitman_yor import (
    BURN_IN,
    END,
    LOCAL_WORDS,
    PARENT_STRENGTH,
    SAMPLES,
    STRENGTH,
    _discount,
    seat,
    tokens,
)
from tallyloom.llm.shared import discard, slices, stored_lean

#: Most frequent pairs, whose scores are sent to all tasks; all others are joined.
HOT = 1 << 17
#: Parts of the documents that are scored one after the other; only one part's shuffles are on disk.
PARTS = 2
#: Rows of a batch of pairs or words.
BATCH = 20_000


class _Numbers(defaultdict):
    """Numbers of words in order of their first use; the end of a text has 0, and so has the beginning as a previous word."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__
        self[END]

    def pairs(self, codes: np.ndarray) -> pa.Array:
        """The keys of pairs given as numbers of the previous word and the word."""
        words = pa.array(list(self), pa.binary())
        return pc.binary_join_element_wise(words.take(pa.array(codes >> 32)), words.take(pa.array(codes & 0xFFFFFFFF)), b" ")

    def codes(self, texts: list[str | None]) -> list[np.ndarray]:
        found = []
        for text in texts:
            words = tokens(text)
            own = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            found.append((np.concatenate(([0], own[:-1])) << 32) | own)
        return found


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair and n: how often every pair of neighbours occurs in the texts."""

    def run(batches):
        numbers, parts = _Numbers(), []

        def merge():
            codes, counts = (np.concatenate(x) for x in zip(*parts))
            unique, inverse = np.unique(codes, return_inverse=True)
            parts[:] = [(unique, np.bincount(inverse, weights=counts).astype(np.int64))]

        def flush():
            merge()
            codes, counts = parts.pop()
            for at in range(0, len(codes), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([numbers.pairs(codes[part]), pa.array(counts[part])], names=["pair", "n"])

        for batch in slices(batches):
            if batch.num_rows:
                parts.append(np.unique(np.concatenate(numbers.codes(batch.column(0).to_pylist())), return_counts=True))
            if len(numbers) > LOCAL_WORDS:
                yield from flush()
                numbers = _Numbers()
            elif len(parts) > 16:
                merge()
        if parts:
            yield from flush()

    counted = texts.mapInArrow(run, "pair binary, n long")
    return counted.groupBy(F.col("pair").cast("string").alias("pair")).agg(F.sum("n").alias("n"))


def _before() -> Column:
    return F.substring_index("pair", " ", 1)


def _word() -> Column:
    return F.substring_index("pair", " ", -1)


@dataclass(frozen=True)
class Sizes:
    """Discounts, number of words, and the customers and tables of the parent restaurant in one sweep."""

    discount: float
    parent_discount: float
    vocabulary: int
    customers: float
    tables: float

    def parent(self, customers, tables):
        """Probability in the parent of words with so many customers and tables there."""
        backing = (PARENT_STRENGTH + self.parent_discount * self.tables) / (self.vocabulary + 1)
        return (customers - tables * self.parent_discount + backing) / (PARENT_STRENGTH + self.customers)

    def share(self, n, tables, customers):
        """What a pair with so many customers and tables has of its context's probability."""
        return (n - tables * self.discount) / (customers + STRENGTH)

    def backing(self, tables, customers):
        """What a context leaves to the parent."""
        return (tables * self.discount + STRENGTH) / (customers + STRENGTH)


@dataclass
class Model:
    """pairs: pair, n, t; contexts: before, c, t0 ...; words: word, n, p0 ..., all in sums over or columns by sample.

    n of a pair is 0 where it only occurs in texts that were not learned from.
    """

    pairs: DataFrame
    contexts: DataFrame
    words: DataFrame
    samples: list[Sizes]
    n_tokens: int
    vocabulary: int


def _seated(rows: DataFrame, sizes: Sizes, number: int) -> DataFrame:
    """Pairs with their tables after all their customers sat down again; rows add the context's tables and the word's share."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, t, total, tables, parent = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, 6))
            ends = batch.column(0)[0].as_py() + batch.column(0)[batch.num_rows - 1].as_py()
            rng = np.random.default_rng([number, zlib.crc32(ends)])
            new = seat(n, tables - t, parent, sizes.discount, STRENGTH, rng).astype(np.int64)
            arrays = [batch.column(0), batch.column(1), pa.array(new), pa.array(total.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["pair", "n", "now", "t"])

    sent = rows.select(F.col("pair").cast("binary").alias("pair"), "n", "now", "t", "tables", "parent")
    return sent.mapInArrow(run, "pair binary, n long, now long, t long").withColumn("pair", F.col("pair").cast("string"))


def _parent_seated(words: DataFrame, sizes: Sizes, number: int) -> DataFrame:
    """Words with their tables in the parent after their customers there sat down again."""
    schema = words.schema

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {name: i for i, name in enumerate(batch.schema.names)}
            word, customers, r = batch.column(at["word"]), *(
                batch.column(at[c]).to_numpy(zero_copy_only=False).astype(float) for c in ("customers", "r")
            )
            rng = np.random.default_rng([number, 1, zlib.crc32(word[0].as_py() + word[batch.num_rows - 1].as_py())])
            uniform = np.full(len(r), 1 / (sizes.vocabulary + 1))
            new = seat(customers, sizes.tables - r, uniform, sizes.parent_discount, PARENT_STRENGTH, rng).astype(np.int64)
            yield batch.set_column(at["r"], "r", pa.array(new))

    sent = words.withColumn("word", F.col("word").cast("binary"))
    return sent.mapInArrow(run, sent.schema).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def train(docs: DataFrame, others: DataFrame | None = None, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Learn from the texts of docs. Pairs of ``others`` are listed as well, but not learned from."""
    counted = pair_counts(docs.select("text"))
    if others is not None:
        unlearned = pair_counts(others.select("text")).select("pair", F.lit(0).cast("long").alias("n"))
        counted = counted.union(unlearned).groupBy("pair").agg(F.sum("n").alias("n"))
    counted = stored_lean(counted)
    learned = counted.filter("n > 0")
    once = F.count_if(F.col("n") == 1)
    listed = [F.lit(0).cast("long").alias(f"t{i}") for i in range(samples)]
    # c: customers; alone: pairs of a single customer; tables: one for each pair at first.
    contexts = stored_lean(learned.groupBy(_before().alias("before")).agg(
        F.sum("n").alias("c"), once.alias("alone"), F.count("*").alias("tables"), *[F.max(x).alias(f"t{i}") for i, x in enumerate(listed)],
    ))
    listed = [F.lit(0.0).alias(f"p{i}") for i in range(samples)]
    words = stored_lean(learned.groupBy(_word().alias("word")).agg(
        F.sum("n").alias("n"), once.alias("alone"), F.count("*").alias("customers"), F.lit(1).cast("long").alias("r"),
        *[F.max(x).alias(f"p{i}") for i, x in enumerate(listed)],
    ))
    pairs = learned.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    shape = words.agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("customers") == 1), F.count_if(F.col("customers") == 2)
    ).first()
    vocabulary, n_tokens = shape[0], shape[1]

    def sizes() -> Sizes:
        found = words.agg(F.coalesce(F.sum("customers"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
        return Sizes(_discount(*pairs), _discount(*shape[2:]), vocabulary, float(found[0]), float(found[1]))

    now = sizes()
    one = F.lit(1).cast("long")
    # now: tables; t: their sum over the samples.
    several = learned.filter("n > 1").select("pair", "n", one.alias("now"), F.lit(0).cast("long").alias("t"))
    history = []
    for number in range(burn_in + samples):
        known = contexts.select("before", "tables")
        shares = words.select("word", now.parent(F.col("customers"), F.col("r")).alias("parent"))
        rows = several.withColumns({"_before": _before(), "_word": _word()}).join(
            known, F.col("_before") == F.col("before")
        ).join(shares, F.col("_word") == F.col("word"))
        old = (several if number else None, contexts, words)
        several = _seated(rows, now, number)
        sample = number - burn_in
        if sample >= 0:
            several = several.withColumn("t", F.col("t") + F.col("now"))
        several = stored_lean(several, rows=BATCH)
        contexts = _added(contexts, several.select(_before().alias("before"), F.col("now").alias("tables")), "tables")
        words = _added(words, several.select(_word().alias("word"), F.col("now").alias("customers")), "customers")
        if sample >= 0:
            contexts = contexts.withColumn(f"t{sample}", F.col("tables"))
        contexts, words = stored_lean(contexts), stored_lean(_parent_seated(words, now, number), rows=BATCH)
        discard(*[x for x in old if x is not None])
        now = sizes()
        if sample >= 0:
            history.append(now)
            words = words.withColumn(f"p{sample}", now.parent(F.col("customers"), F.col("r")))
    single = counted.filter("n <= 1").select("pair", "n", (F.col("n") * samples).alias("t"))
    return Model(single.union(several.select("pair", "n", "t")), contexts, words, history, n_tokens, vocabulary)


def _added(state: DataFrame, tables: DataFrame, column: str) -> DataFrame:
    """The state with a column worked out anew: its pairs of a single customer and the tables of all other pairs."""
    key = state.columns[0]
    rest = [c for c in state.columns if c not in (key, column)]
    kinds = dict(state.dtypes)
    moved = tables.select(key, F.col(column), *[F.lit(0).cast(kinds[c]).alias(c) for c in rest])
    fixed = state.select(key, F.col("alone").alias(column), *rest)
    return fixed.union(moved).groupBy(key).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in state.columns if c != key])


def pair_scores(model: Model, pairs: DataFrame) -> DataFrame:
    """pair, times (n of the pair), n (of its word) and score, the log10 probability of the word behind the previous one."""
    samples = model.samples
    rows = pairs.withColumns({"times": F.col("n"), "_before": _before(), "_word": _word()}).drop("n").join(
        model.contexts, F.col("_before") == F.col("before"), "left"
    ).join(model.words.drop("customers", "alone", "r"), F.col("_word") == F.col("word"), "left")
    c = F.coalesce("c", F.lit(0))
    own = F.when(F.col("times") > 0, samples[0].share(F.col("times"), F.col("t") / len(samples), c)).otherwise(0.0)
    parents = [
        s.backing(F.coalesce(f"t{i}", F.lit(0)), c) * F.coalesce(f"p{i}", F.lit(s.parent(0.0, 0.0))) for i, s in enumerate(samples)
    ]
    p = own + reduce(add, parents) / len(samples)
    return rows.select("pair", "times", F.coalesce("n", F.lit(0)).alias("n"), F.log10(p).alias("score"))


def score(docs: DataFrame, model: Model, listed: bool = False, hot: int = HOT, parts: int = PARTS) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of docs, as ``pitman_yor.score`` gives them.

    ``listed`` tells that the model lists all pairs of docs, which need not be looked for then.
    """
    pairs = model.pairs
    if not listed:
        own = pair_counts(docs.select("text")).select("pair", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("t"))
        pairs = pairs.union(own).groupBy("pair").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    scored = stored_lean(pair_scores(model, pairs))
    top = scored.filter("times > 1").orderBy(F.desc("times"), "pair").limit(hot)
    top = top.select(F.col("pair").cast("binary").alias("pair"), "n", "score").toArrow()
    denominator = model.n_tokens + model.vocabulary + 1
    frequent = {w: i for i, w in enumerate(top.column("pair").to_pylist())}
    n, log_p = top.column("n").to_numpy(), top.column("score").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((frequent, n, np.log10((n + 1) / denominator), log_p))
    kind = docs.schema["doc_id"].dataType
    names = ["row", "pair", "times", "doc_id", "n_tokens", "known", "base", "log_p"]
    schema = f"row long, pair binary, times long, doc_id {kind.simpleString()}, n_tokens long, known long, base double, log_p double"

    def run(batches):
        frequent, n, base, log_p = sent.value
        task, at = TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches):
            size = batch.num_rows
            if not size:
                continue
            numbers = _Numbers()
            codes = numbers.codes(batch.column(1).to_pylist())
            lengths = np.array([len(c) for c in codes])
            unique, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            # Every pair of a document once, with its times.
            each, times = np.unique(inverse * size + np.repeat(np.arange(size), lengths), return_counts=True)
            which, doc = each // size, each % size
            keys = numbers.pairs(unique)
            found = np.fromiter((frequent.get(k, -1) for k in keys.to_pylist()), np.int64, len(unique))[which]
            is_hot = found >= 0
            at_hot, d, t = found[is_hot], doc[is_hot], times[is_hot]

            def summed(x):
                return np.bincount(d, weights=x, minlength=size).astype(float)

            rows = task + at + np.arange(size)
            at += size
            # A document's own row has a key without a blank, which no pair has.
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array([b"%d" % r for r in rows.tolist()], pa.binary()), pa.array(np.zeros(size, np.int64)),
                 batch.column(0), pa.array(lengths.astype(np.int64)),
                 pa.array(summed(t * (n[at_hot] > 0)).astype(np.int64)), pa.array(summed(t * base[at_hot])),
                 pa.array(summed(t * log_p[at_hot]))],
                names=names,
            )
            rest = np.flatnonzero(~is_hot)
            for start in range(0, len(rest), 100_000):
                part = rest[start : start + 100_000]
                empty = [pa.nulls(len(part), batch.column(0).type), *(pa.nulls(len(part), x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[doc[part]]), keys.take(pa.array(which[part])), pa.array(times[part].astype(np.int64)), *empty],
                    names=names,
                )

    done = []
    for part in range(parts):
        own = F.pmod(F.xxhash64("text"), F.lit(parts)) == part
        read = docs.select("doc_id", "text").filter(own).mapInArrow(run, schema).withColumn("pair", F.col("pair").cast("string"))
        joined = read.join(scored.select(F.col("pair").alias("_pair"), "n", "score"), F.col("pair") == F.col("_pair"), "left")
        sums = joined.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
            (F.sum("known") + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("times"))), F.lit(0))).alias("n_known"),
            (F.sum("base") + F.coalesce(F.sum(F.col("times") * F.log10((F.col("n") + 1) / denominator)), F.lit(0.0))).alias("base_score"),
            (F.sum("log_p") + F.coalesce(F.sum(F.col("times") * F.col("score")), F.lit(0.0))).alias("score"),
        )
        done.append(stored_lean(sums.drop("row")))
    return reduce(DataFrame.unionByName, done)
