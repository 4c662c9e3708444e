"""Document quality by hierarchical empirical Bayes: document, path and host.

1. A logistic classifier over binned properties of the text is fitted on a bounded sample of
   labelled documents. Its log odds against the sample's prior are the document's own evidence.
2. Every document contributes its label, if it may be learned from, or else the classifier's
   probability to its path (a part of a host) and its host. These are sums per group.
3. The spread of the host means gives a global beta prior, the spread of the paths around their
   hosts the strength of a host's prior for its paths. Sparse hosts shrink toward the global mean,
   sparse paths toward their host.
4. A document's posterior combines its evidence with its path's mean, from which its own
   contribution is taken out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import by_batches, remainder, stored
from tallyloom.llm.toxicity import fit_linear

#: Bound of the labelled sample, per class.
MAX_LABELLED = 12_000
BINS = 12
THRESHOLD = 0.5
LETTERS, UPPERS, DIGITS = (bytes(range(a, b + 1)) for a, b in ((97, 122), (65, 90), (48, 57)))
STOPS, SYMBOLS = b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"
SENTENCE = re.compile(r"[.!?](?:\s|$)")


def properties(text: str | None) -> list[float]:
    """Numbers that tell prose from junk; all zero for a text without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * 11
    raw = text.encode("utf-8", "surrogatepass")
    size, n = len(raw), len(words)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n), len(counts) / n**0.8, counts.most_common(1)[0][1] / n, share(STOPS), share(SYMBOLS),
        share(DIGITS), share(UPPERS), len(text) / n, 1 - len(set(lines)) / max(1, len(lines)),
        len(SENTENCE.findall(text)) / n, 1 - pairs / max(1, n - 1),
    ]


@dataclass
class Model:
    edges: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    prior: float = 0.5


def _active(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Numbers of the bins that the properties fall in."""
    bins = [np.searchsorted(e, values[:, j], side="right") + j * BINS for j, e in enumerate(edges)]
    return np.stack(bins, axis=1)


def _sample(labels: DataFrame, bound: int) -> DataFrame:
    own = (
        labels.filter("doc_id is not null and quality is not null").filter(remainder("doc_id", 3) != 1)
        .groupBy(F.col("doc_id").alias("sample_id")).agg(F.min("quality").alias("quality"))
    )
    order = (F.xxhash64("sample_id"), F.col("sample_id"))
    return own.filter("quality = 1").orderBy(*order).limit(bound).union(
        own.filter("quality <> 1").orderBy(*order).limit(bound)
    )


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """Fit the document classifier on at most 2 * ``bound`` labelled documents.

    A document labelled more than once is good only if all labels say so. Without labels of both
    classes there is no evidence, and the prior is the labels' share, or one half without any.
    """
    ids = stored(_sample(labels, bound))
    # The sample's bound is the broadcast's: 2 * bound ids.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id"))

    def run(columns):
        return {"quality": columns["quality"], "values": [properties(t) for t in columns["text"].to_pylist()]}

    rows = by_batches(sample.select("text", "quality"), run, "quality int, values array<double>").orderBy("values", "quality").collect()
    target = np.array([float(r.quality == 1) for r in rows])
    if not len(rows) or target.min() == target.max():
        return Model(prior=float(target.mean()) if len(rows) else 0.5)
    values = np.array([list(r["values"]) for r in rows])
    edges = np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    weights, bias = fit_linear(_active(values, edges).tolist(), target, BINS * len(edges), l2=1e-4)
    # fit_linear weighs both classes equally, so its odds are evidence against even odds.
    return Model(edges, weights, bias, float(target.mean()))


def evidence(values: np.ndarray, model: Model) -> np.ndarray:
    if model.weights is None:
        return np.zeros(len(values))
    return np.clip(model.bias + model.weights[_active(values, model.edges)].sum(axis=1), -12, 12)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def score_quality(
    docs: DataFrame, labels: DataFrame, model: Model, host: str = "source", path: str = "lang",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, doc_score, host_mean, path_mean, score and kept of every row.

    ``host`` and ``path`` name columns of docs; null is a host or path of its own. held_out: the
    crc32 of doc_id as text leaves 1 when divided by 3; labels of such rows are never used. Null
    texts count as empty. Repeated rows each count and get equal results. Other columns are
    ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(columns):
        values = np.array([properties(t) for t in columns["text"].to_pylist()]).reshape(-1, 11)
        return {c: columns[c] for c in ("doc_id", "host", "path")} | {"evidence": evidence(values, model).tolist()}

    source = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    read = by_batches(source, run, f"doc_id {kind}, host string, path string, evidence double")
    known = (
        labels.filter("doc_id is not null and quality is not null").filter(remainder("doc_id", 3) != 1)
        .groupBy(F.col("doc_id").alias("own_id")).agg((F.min("quality") == 1).cast("double").alias("label"))
    )
    odds = math.log(min(max(model.prior, 1e-3), 1 - 1e-3) / (1 - min(max(model.prior, 1e-3), 1 - 1e-3)))
    rows = stored(
        read.join(known, F.col("doc_id") == F.col("own_id"), "left")
        .withColumn("doc_score", _sigmoid(F.col("evidence") + odds))
        .withColumn("own", F.coalesce("label", "doc_score")).drop("own_id", "label")
    )
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("s")))
    hosts = stored(paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")))
    mean, strength = _beta(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s"), F.lit(None).cast("double").alias("m")))
    hosts = stored(hosts.withColumn("host_mean", (F.col("host_s") + strength * mean) / (F.col("host_n") + strength)))
    inside = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    _, inner = _beta(inside.select("n", "s", F.col("host_mean").alias("m")))
    groups = stored(inside.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_mean"))
    others = (F.col("s") - F.col("own") + inner * F.col("host_mean")) / (F.col("n") - 1 + inner)
    prior = F.least(F.greatest(others, F.lit(1e-4)), F.lit(1 - 1e-4))
    return (
        rows.join(groups, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
        .withColumn("path_mean", prior)
        .withColumn("score", _sigmoid(F.col("evidence") + F.log(prior / (1 - prior))))
        .select(
            "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
            "doc_score", "host_mean", "path_mean", "score", (F.col("score") >= threshold).alias("kept"),
        )
    )


def _beta(groups: DataFrame) -> tuple[float, float]:
    """Mean and strength of a beta prior by moments, from groups' n and s (and expected mean m).

    The strength is what the spread of the group means leaves after the noise of their sizes.
    """
    total = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total.n:
        return 0.5, 2.0
    mean = min(max(total.s / total.n, 1e-3), 1 - 1e-3)
    m = F.coalesce("m", F.lit(mean))
    spread = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)).alias("between"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    if spread.k < 2:
        return mean, 2.0
    noise = mean * (1 - mean)
    true = (spread.between - (spread.k - 1) * noise) / max(total.n - spread.squares / total.n, 1e-9)
    true = min(max(true, noise / 1e4), noise / 1.5)
    return mean, noise / true - 1
