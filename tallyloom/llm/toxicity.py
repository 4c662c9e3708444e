"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Lexicons are induced from a bounded sample of labelled documents: words and word beginnings
   whose share among toxic documents is far above that among clean ones.
2. Every document is read by many voters: lexicons by kind and strength, and patterns. Documents
   are counted by their vector of votes, at most 2**len(VOTERS) of them.
3. Expectation-maximisation on these counts, with the sample's labels held fixed, estimates how
   often each voter fires on either class. Correlations of voters within a class discount the
   votes of those that repeat each other.
4. A logistic classifier over the lexicon terms and patterns is trained on the posterior labels
   of the sample and scores all documents.

Texts are read where they are; only counts, votes and the sample's few matches move.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import by_batches, remainder, slices, stored

#: Bounds of the labelled sample, of the lexicon, and of the terms counted at a time in a task.
MAX_TOXIC, MAX_CLEAN, MAX_TERMS, MAX_COUNTED = 12_000, 24_000, 2_000, 150_000
MIN_DOCUMENTS, MIN_LOG_ODDS, STRONG = 4, 2.0, 4.0
THRESHOLD = 0.7
#: Stripped from the ends of words.
MARKS = string.punctuation + "¡¿«»„“”‘’…–—"
#: Letters with the accents, vowel signs and joiners written as characters of their own.
JOINED = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M") + "\u00ad\u200c\u200d"
LETTERS = re.compile(rf"(?:[^\W\d_]|[{JOINED}])+")
BEGINNINGS = (4, 5, 6, 7)
#: How far the label of a sampled document is trusted as one voter among the others.
LABEL_ACCURACY = 0.95
SHOUT, BANGS, MASKED = re.compile(r"[A-Z]{4}"), re.compile(r"!!|\?\?\?"), re.compile(r"\w\*{2,}")
ADDRESSED = frozenset(("you", "your", "yourself"))
VOTERS = (
    "word", "strong_word", "short_begin", "strong_short_begin", "long_begin", "strong_long_begin",
    "two_words", "three_words", "dense", "shout", "bangs", "masked", "addressed",
)


@dataclass
class Model:
    base: float = 0.0
    terms: dict[str, int] = field(default_factory=dict)
    strong: frozenset[str] = frozenset()
    #: First four letters of all terms; a word without such a beginning can match none.
    roots: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    bias: float = 0.0
    firing: np.ndarray | None = None
    discount: np.ndarray | None = None


def words_of(text: str) -> tuple[set[str], int]:
    """The different words of a text, lower-cased, and the number of all between blanks.

    A word is a run of letters; most are found by taking away the marks at the ends of a token.
    """
    parts = text.lower().split()
    words = set()
    for p in set(parts):
        w = p.strip(MARKS)
        if w.isalpha():
            words.add(w)
        elif w:
            words.update(x for x in LETTERS.findall(w) if x[0].isalpha())
    return words, len(parts)


def terms_of(words) -> set[str]:
    """Words and word beginnings, these marked by their length."""
    terms = set(words)
    for n in BEGINNINGS:
        terms.update([f"{n}{w[:n]}" for w in words if len(w) > n])
    return terms


def _kind(term: str) -> str:
    """Voter of a term: a word, or a shorter or longer beginning of words."""
    if not term[0].isdigit():
        return "word"
    return "short_begin" if int(term[0]) < 6 else "long_begin"


def matches(text: str | None, model: Model) -> tuple[list[int], int]:
    """Numbers of the lexicon terms in a text and its votes, one bit per voter."""
    text = text or ""
    words, n_words = words_of(text)
    near = [w for w in words if w[:4] in model.roots]
    found = terms_of(near) & model.terms.keys() if near else set()
    strong = found & model.strong
    kinds = {_kind(t) for t in found} | {f"strong_{_kind(t)}" for t in strong}
    hits = sum(
        w in found or any(f"{n}{w[:n]}" in found for n in BEGINNINGS if len(w) > n)
        for w in near
    ) if found else 0
    if hits > 1:
        kinds.add("two_words")
    if hits > 2:
        kinds.add("three_words")
    if 50 * hits > n_words:
        kinds.add("dense")
    if SHOUT.search(text):
        kinds.add("shout")
    if BANGS.search(text):
        kinds.add("bangs")
    if "**" in text and MASKED.search(text):
        kinds.add("masked")
    if not ADDRESSED.isdisjoint(words):
        kinds.add("addressed")
    votes = sum(1 << i for i, name in enumerate(VOTERS) if name in kinds)
    return sorted(model.terms[t] for t in found), votes


def labelled_sample(labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """sample_id and toxic of a bounded sample of the documents that may be learned from.

    Of each class the first rows in the order of a hash of the id. A document labelled more than
    once is toxic if any label says so.
    """
    own = (
        labels.filter("doc_id is not null and toxic is not null")
        .filter(remainder("doc_id", 3) != 1)
        .groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("toxic").alias("toxic"))
    )
    order = (F.xxhash64("sample_id"), F.col("sample_id"))
    return own.filter("toxic = 1").orderBy(*order).limit(max_toxic).union(
        own.filter("toxic <> 1").orderBy(*order).limit(max_clean)
    )


def _term_counts(sample: DataFrame) -> DataFrame:
    """Documents of the sample with each term, by class."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            names = list(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([counts[n][k] for n in names], pa.int64()) for k in (1, 0))],
                names=["term", "in_toxic", "in_clean"],
            )
            counts.clear()
            return out

        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for term in terms_of(words_of(text or "")[0]):
                    counts.setdefault(term, [0, 0])[toxic == 1] += 1
                if len(counts) > MAX_COUNTED:
                    yield flush()
        yield flush()

    pairs = sample.mapInArrow(run, "term string, in_toxic long, in_clean long")
    return pairs.groupBy("term").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))


def label_model(votes: dict[int, float], fixed: dict[tuple[int, int], float], rounds: int = 30):
    """Estimate how often voters fire by class, and discounts for correlated ones.

    ``votes``: documents by vote vector, labels unknown; ``fixed``: the same by vector and label.
    Returns the shares of firing (class, voter), discounts, and the prior of toxic.
    """
    vectors = sorted({*votes, *(v for v, _ in fixed)})
    bits = np.array([[v >> i & 1 for i in range(len(VOTERS))] for v in vectors], dtype=float)
    known = np.array([[fixed.get((v, c), 0.0) for c in (0, 1)] for v in vectors])
    free = np.array([max(0.0, votes.get(v, 0.0) - known[i].sum()) for i, v in enumerate(vectors)])
    weight = known.copy()
    discount = np.ones(len(VOTERS))
    for _ in range(rounds):
        total = weight.sum(axis=0)
        firing = (weight.T @ bits + 0.5) / (total[:, None] + 1.0)
        prior = (total[1] + 0.5) / (total.sum() + 1.0)
        shared = np.zeros((len(VOTERS), len(VOTERS)))
        for c in (0, 1):
            off = bits - firing[c]
            cov = (off * weight[:, [c]]).T @ off / max(total[c], 1.0)
            scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov))) + 1e-9
            shared = np.maximum(shared, np.clip(cov / scale, 0, 1))
        np.fill_diagonal(shared, 0)
        discount = 1 / (1 + shared.sum(axis=1))
        post = posterior(bits, firing, discount, prior)
        weight = known + free[:, None] * np.stack([1 - post, post], axis=1)
    return firing, discount, prior


def posterior(bits: np.ndarray, firing: np.ndarray, discount: np.ndarray, prior: float, label=0.0) -> np.ndarray:
    """Probability of toxic given the votes, and the log odds that a label adds."""
    on, off = np.log(firing[1] / firing[0]), np.log((1 - firing[1]) / (1 - firing[0]))
    odds = label + np.log(prior / (1 - prior)) + (discount * np.where(bits > 0, on, off)).sum(axis=-1)
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _features(found: list[int], votes: int, n_terms: int) -> list[int]:
    """Terms, number of words hit, and patterns."""
    return found + [n_terms + i for i, name in enumerate(VOTERS) if name in PLAIN and votes >> i & 1]


PLAIN = frozenset(("two_words", "three_words", "dense", "shout", "bangs", "masked", "addressed"))


def fit_linear(rows: list[list[int]], target: np.ndarray, width: int, rounds: int = 400, l2: float = 1e-5):
    """Logistic regression on sparse binary features by Adam; returns weights and bias."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], dtype=np.int64)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(rows)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(at, weights=w[cols], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight
        grad = np.append(np.bincount(cols, weights=error[at], minlength=width) + l2 * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:width], b - move[width]
    return w, b


def train(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN,
    max_terms: int = MAX_TERMS,
) -> Model:
    """Learn lexicons, label model and classifier; see the module's description.

    Only the sample, ``max_toxic`` and ``max_clean`` labelled rows at most, is learned from with
    labels; votes are counted over all documents. Without labels of both classes the model gives
    every text the share of toxic ones among the labels.
    """
    ids = stored(labelled_sample(labels, max_toxic, max_clean))
    sizes = {r.toxic: r["count"] for r in ids.groupBy(F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(base=1.0 if toxic else 0.0)
    plain = docs.select("doc_id", "text")
    # The sample's bound is the broadcast's: max_toxic + max_clean ids.
    sample = stored(plain.join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id")).select("text", "toxic"))
    rate = lambda column, total: (F.col(column) + 0.5) / (total + 1.0)
    gain = F.log(rate("in_toxic", toxic) / (1 - rate("in_toxic", toxic))) - F.log(
        rate("in_clean", clean) / (1 - rate("in_clean", clean))
    )
    chosen = (
        _term_counts(sample).withColumn("gain", gain)
        .filter((F.col("in_toxic") >= min(MIN_DOCUMENTS, toxic)) & (F.col("gain") >= MIN_LOG_ODDS))
        .orderBy(F.desc(F.col("gain") * F.sqrt("in_toxic")), "term").limit(max_terms).collect()
    )
    model = Model(
        base=toxic / (toxic + clean),
        terms={r.term: i for i, r in enumerate(chosen)},
        strong=frozenset(r.term for r in chosen if r.gain >= STRONG),
        roots=frozenset((r.term[1:] if r.term[0].isdigit() else r.term)[:4] for r in chosen),
    )

    def read_votes(columns):
        return {"votes": [matches(t, model)[1] for t in columns["text"].to_pylist()]}

    def read_sample(columns):
        read = [matches(t, model) for t in columns["text"].to_pylist()]
        return {"found": [r[0] for r in read], "votes": [r[1] for r in read], "toxic": columns["toxic"]}

    counted = by_batches(plain.select("text"), read_votes, "votes long").groupBy("votes").count().collect()
    rows = by_batches(sample, read_sample, "found array<int>, votes long, toxic int").collect()
    if not rows:
        return Model(base=model.base)
    fixed = Counter((r.votes, int(r.toxic == 1)) for r in rows)
    firing, discount, prior = label_model({r.votes: r["count"] for r in counted}, fixed)
    bits = np.array([[r.votes >> i & 1 for i in range(len(VOTERS))] for r in rows], dtype=float)
    trust = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * np.array([1.0 if r.toxic == 1 else -1.0 for r in rows])
    target = posterior(bits, firing, discount, prior, trust)
    n = len(model.terms)
    model.weights, model.bias = fit_linear(
        [_features(r.found, r.votes, n) for r in rows], target, n + len(VOTERS)
    )
    model.firing, model.discount = firing, discount
    return model


def score_text(text: str | None, model: Model) -> float:
    if model.weights is None:
        return model.base
    found, votes = matches(text, model)
    z = model.bias + sum(model.weights[i] for i in _features(found, votes, len(model.terms)))
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with score, held_out and predicted, which replace such of docs.

    The score depends on the text alone; null counts as empty. held_out: the crc32 of doc_id as
    text leaves remainder 1 when divided by 3 (false for a null id, which is never learned from
    either). Repeated rows get equal scores; an empty table gives an empty result.
    """
    added = ("score", "held_out", "predicted")
    kept = [c for c in docs.columns if c.lower() not in added]

    def run(columns):
        return {c: columns[c] for c in kept} | {"score": [score_text(t, model) for t in columns["text"].to_pylist()]}

    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return (
        by_batches(docs.select(*kept), run, f"{names}score double")
        .withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
