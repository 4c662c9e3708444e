"""Shallot search against a full comparison of every vector with every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyloom.llm.centroids import _Search, centroid_table, cluster

SCHEMA = "vec_id long, embedding array<float>, first string, v int, square int"


def plain(rows, k, rounds, dims, scale=64):
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in e])
        for i, e in rows
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)
    ]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                members = [v for (_, v), (_, a) in zip(kept, own) if a == j]
                if members:
                    centroids[j] = [sum(col) // len(members) for col in zip(*members)]
    return sorted((str(i), a, d) for (i, _), (d, a) in zip(kept, own)), centroids


def found_rows(found):
    return sorted((str(r.id), r["first"], r["square"]) for r in found.rows.collect())


def lumps(rng, n, dims, groups, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("dims,k,rounds,spread", [(8, 16, 3, 0.05), (8, 5, 6, 0.4), (2, 7, 3, 0.02), (3, 1, 2, 0.3), (4, 2, 3, 0.2)])
def test_equals_full_comparison(spark, dims, k, rounds, spread):
    rows = lumps(random.Random(dims * k), 300, dims, 6, spread)
    docs = spark.createDataFrame([(i, e, "x", 1, 2) for i, e in rows], SCHEMA)
    found = cluster(docs, k=k, rounds=rounds, dims=dims)
    expected, centroids = plain(rows, k, rounds, dims)
    assert found_rows(found) == expected and found.centroids == centroids
    assert len(found.computed) == rounds + 1


def test_ties_repeated_rows_and_equal_centroids(spark):
    """Few different points: equal starting centroids, many equal distances, empty clusters."""
    rng = random.Random(4)
    points = [[0.0, 0.0], [0.5, 0.0], [0.25, 0.0], [0.0, 0.5], [0.5, 0.5]]
    rows = [(rng.randrange(40), rng.choice(points)) for _ in range(200)]
    found = cluster(spark.createDataFrame([(i, e, "", 0, 0) for i, e in rows], SCHEMA), k=9, dims=2)
    expected, centroids = plain(rows, 9, 3, 2)
    assert found_rows(found) == expected and found.centroids == centroids


def test_unusable_vectors_and_null_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, None), (3, []), (4, [0.1]), (5, [0.1, None]), (6, [nan, 0.0]), (7, [0.0, -inf]),
            (8, [0.1, 0.2, 0.3]), (None, [0.9, 0.9]), (None, [-0.9, 0.9]), (9, [-0.01, 0.999])]
    docs = spark.createDataFrame([(i, e, "", 0, 0) for i, e in rows], SCHEMA)
    found = cluster(docs, k=16, dims=2)
    expected, centroids = plain(rows, 16, 3, 2)
    assert len(expected) == 4 and found_rows(found) == expected and found.centroids == centroids
    table = {r.cluster: r for r in centroid_table(spark, found).collect()}
    assert table[0].centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[0])).encode()).hexdigest()
    assert table[0].inertia == sum(d for _, _, d in expected)


def test_empty_table_and_components_too_large(spark):
    found = cluster(spark.createDataFrame([], SCHEMA), dims=2)
    assert found.rows.count() == 0 and found.centroids == [] and centroid_table(spark, found).count() == 0
    with pytest.raises(Exception, match="beyond"):
        cluster(spark.createDataFrame([(1, [1e30, 0.0], "", 0, 0)], SCHEMA), dims=2)


def test_search_skips_most_distances(spark):
    rows = lumps(random.Random(1), 2000, 16, 16, 0.03)
    found = cluster(spark.createDataFrame([(i, e, "", 0, 0) for i, e in rows], SCHEMA), dims=16)
    assert found_rows(found) == plain(rows, 16, 3, 16)[0]
    # A full comparison takes 16 distances for each vector and pass.
    assert sum(found.computed) < 2000 * 16 * 4 / 2 and found.computed[-1] < 2000 * 4


def test_bounds_hold_after_each_round():
    rng = np.random.default_rng(2)
    v = rng.integers(-60, 60, (400, 6))
    before, centroids = None, v[:12].copy()
    first, second = np.zeros(400, dtype=np.int64), np.ones(400, dtype=np.int64)
    upper, lower = np.full(400, np.inf), np.zeros(400)
    for _ in range(6):
        first, second, upper, lower, square, _ = _Search(centroids, before).assign(v, first, second, upper, lower)
        full = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (first == full.argmin(axis=1)).all() and (square == full.min(axis=1)).all()
        assert (upper >= np.sqrt(full.min(axis=1))).all() and (first != second).all()
        full[np.arange(400), first] = 1 << 40
        assert (lower <= np.sqrt(full.min(axis=1))).all()
        before, centroids = centroids, np.array([v[first == j].mean(axis=0).astype(int) if (first == j).any() else c for j, c in enumerate(centroids)])
