"""Exact k-means on integer vectors with the Shallot search.

Every vector remembers its centroid, its second-nearest centroid, an upper bound of the distance to
the first and a lower bound of the distance to all others. While the bounds stay apart nothing is
computed. Otherwise the exact distances to both remembered centroids are taken, and the search
starts from the closer one: its neighbours, sorted by distance, are visited until they leave the
ball around it whose radius is the vector's distance to it plus the distance of the second-best
centroid found so far, so that the ball shrinks while the search goes on. A centroid outside is
farther than the second-best by the triangle inequality. Bounds are floating-point numbers widened
by a relative margin; whatever survives them is compared by exact integer squares.

Work per round is one pass over the vectors. Only k centroids, their sums and counts reach the
driver; vectors with their bounds are stored in the shared folder after each round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyloom.llm.shared import by_batches, stored

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Bounds are widened by this part, far more than what rounding of square roots can cost.
MARGIN = 1e-9
#: Largest size of a scaled component for which squared distances of 64 components fit a long.
LARGEST = 1 << 27


@dataclass
class Clustering:
    """Result of ``cluster``: rows, final centroids, and distances computed in each pass."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]
    computed: list[int]


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of the scaled components, of every complete and finite vector.

    A scaled component beyond 2**27 raises an error, since squared distances would not fit a long.
    """
    own = F.col("embedding")
    finite = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def floor(x):
        scaled = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(scaled) <= LARGEST, F.floor(scaled).cast("long")).otherwise(
            F.raise_error(F.lit(f"A component times {scale} is beyond {LARGEST}.")).cast("long")
        )

    return vectors.filter(F.coalesce(F.size(own) == dims, F.lit(False)) & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").alias("id"), F.transform(own, floor).alias("v")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _square(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    diff = rows - centroids
    return np.einsum("ij,ij->i", diff, diff)


class _Search:
    """One round's centroids: sorted neighbours, and how far each has moved since the last round."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        diff = centroids[:, None, :] - centroids[None, :, :]
        self.centroids = centroids
        self.apart = np.sqrt(np.einsum("abi,abi->ab", diff, diff).astype(np.float64)) * (1 - MARGIN)
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        moved = np.zeros(k) if before is None else np.sqrt(_square(centroids, before).astype(np.float64)) * (1 + MARGIN)
        self.moved = moved
        # The farthest that any other centroid than a vector's own has come nearer.
        self.others = np.array([max((moved[j] for j in range(k) if j != i), default=0.0) for i in range(k)])

    def assign(self, v, first, second, upper, lower):
        """New (first, second, upper, lower, squared distance to first), and distances computed per vector."""
        k = len(self.centroids)
        upper = upper + self.moved[first]
        lower = lower - self.others[first]
        square = _square(v, self.centroids[first])
        computed = np.ones(len(v), dtype=np.int64)
        upper = np.minimum(upper, np.sqrt(square.astype(np.float64)) * (1 + MARGIN))
        rows = np.flatnonzero(~(upper < lower)) if k > 1 else np.zeros(0, dtype=np.int64)
        if len(rows):
            own = v[rows]
            a, b = first[rows], second[rows]
            da, db = square[rows], _square(own, self.centroids[b])
            computed[rows] += 1
            swap = (db < da) | ((db == da) & (b < a))
            start, other = np.where(swap, b, a), np.where(swap, a, b)
            best, best_at = np.where(swap, db, da), start.copy()
            next_, next_at = np.where(swap, da, db), other.copy()
            reach = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
            active = np.arange(len(rows))
            for rank in range(k):
                near = self.order[start[active], rank]
                ball = reach[active] + np.sqrt(next_[active].astype(np.float64)) * (1 + MARGIN)
                inside = self.apart[start[active], near] <= ball
                active, near = active[inside], near[inside]
                if not len(active):
                    break
                # A centroid that equals the start may stand before it in the order.
                new = (near != other[active]) & (near != start[active])
                at, j = active[new], near[new]
                d = _square(own[at], self.centroids[j])
                computed[rows[at]] += 1
                wins = (d < best[at]) | ((d == best[at]) & (j < best_at[at]))
                w, x = at[wins], at[~wins]
                next_[w], next_at[w] = best[w], best_at[w]
                best[w], best_at[w] = d[wins], j[wins]
                d, j = d[~wins], j[~wins]
                closer = (d < next_[x]) | ((d == next_[x]) & (j < next_at[x]))
                next_[x[closer]], next_at[x[closer]] = d[closer], j[closer]
            first, second = first.copy(), second.copy()
            first[rows], second[rows], square[rows] = best_at, next_at, best
            upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
            lower[rows] = np.sqrt(next_.astype(np.float64)) * (1 - MARGIN)
        return first, second, upper, lower, square, computed


def _pass(state: DataFrame, dims: int, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """Assign every vector; without earlier centroids the search starts with the first two and no bounds."""
    search = _Search(centroids, before)
    id_type = state.schema["id"].dataType.simpleString()

    def run(columns):
        v = _matrix(columns["v"], dims)
        n = len(v)
        if before is None:
            first, second = np.zeros(n, dtype=np.int64), np.full(n, min(1, len(centroids) - 1))
            upper, lower = np.full(n, np.inf), np.zeros(n)
        else:
            first, second = (columns[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "second"))
            upper, lower = (columns[c].to_numpy(zero_copy_only=False) for c in ("upper", "lower"))
        first, second, upper, lower, square, computed = search.assign(v, first, second, upper, lower)
        return {
            "id": columns["id"], "v": columns["v"], "first": first, "second": second,
            "upper": upper, "lower": lower, "square": square, "computed": computed,
        }

    schema = f"id {id_type}, v array<bigint>, first int, second int, upper double, lower double, square long, computed long"
    return stored(by_batches(state, run, schema))


def _floors(sums: list[int], count: int) -> list[int]:
    return [s // count for s in sums]


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> Clustering:
    """Cluster the complete vectors of a table (columns vec_id and embedding; others are passed over).

    Vectors of another length, or with a null or non-finite component, and null vectors are left
    out. Centroids start as the k vectors with the smallest sha256 of ``<seed>:<vec_id>``; equal
    ids are told apart by their components, null ids come last. With fewer vectors than k there
    are fewer centroids, with none the result is empty. Repeated rows are vectors of their own.
    Ties go to the smaller centroid number; a centroid without vectors stays. Rows: id, first (the
    centroid), second, square (squared distance), upper, lower, computed.
    """
    base = stored(integer_vectors(vectors, dims, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = base.orderBy(digest.asc_nulls_last(), "v").select("v").limit(k).collect()
    if not start:
        schema = f"{base.schema['id'].simpleString().replace(':', ' ')}, first int, second int, square long, upper double, lower double, computed long"
        return Clustering(base.sparkSession.createDataFrame([], schema), [], [], [])
    centroids, before, state, computed = np.array([r["v"] for r in start], dtype=np.int64), None, base, []
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    for turn in range(rounds + 1):
        state = _pass(state, dims, centroids, before)
        if turn == rounds:
            break
        # k rows of counts and sums.
        found = state.groupBy("first").agg(F.count("*").alias("n"), F.sum("computed").alias("computed"), *sums).collect()
        computed.append(sum(r["computed"] for r in found))
        before, centroids = centroids, centroids.copy()
        for r in found:
            centroids[r["first"]] = _floors([r[f"s{i}"] for i in range(dims)], r["n"])
    inertia = [0] * len(centroids)
    last = state.groupBy("first").agg(F.sum("square").alias("inertia"), F.sum("computed").alias("computed")).collect()
    for r in last:
        inertia[r["first"]] = r["inertia"]
    computed.append(sum(r["computed"] for r in last))
    return Clustering(state.drop("v"), centroids.tolist(), inertia, computed)


def centroid_table(spark, found: Clustering) -> DataFrame:
    """cluster, cluster_inertia, inertia and centroid_sha256, one row for each of the k centroids."""
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    total = sum(found.inertia)
    rows = [
        Row(i, found.inertia[i], total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(found.centroids)
    ]
    return spark.createDataFrame(rows, schema)
