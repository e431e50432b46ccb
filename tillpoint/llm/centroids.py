"""Centroid clustering with Ptolemaic pivots.

Vectors become integer points, so every distance, sum and mean is exact. A few
of the first centroids, far from each other, are the fixed pivots; each
vector's distances to them are computed once and stored beside it. In every
round the pivots' distances to the centroids are known too, and for any pair
of pivots p, s Ptolemy's inequality bounds the distance of vector v and
centroid c from below:

    d(v, c) >= |d(v, p) d(c, s) - d(v, s) d(c, p)| / d(p, s)

The bound is rounded down by more than its floating point error. A vector's
exact distance to the centroid of least bound is its first best; a centroid
whose bound is above the best so far is passed over, every other one is
compared exactly. Ties go to the smaller number.

Each round is one map over the stored table: a task sends one partial sum and
count per cluster, added by (cluster, component) across tasks; only the
centroids (``k`` rows) come to the driver and go out with the next round.

A vector is kept if it has exactly ``dims`` components, none null or
non-finite; all others, null vectors included, give no row. Components must be
smaller than 2**19 in size (a squared distance would not fit a long), else the
job fails with that message. Rows with a null id count like all others and can
be a first centroid only after those with an id; rows of one id are taken by
components. Repeated vectors are assigned alike and all count. Fewer kept
vectors than ``k`` make as many centroids. An empty cluster keeps its
centroid. No kept vectors give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.scratch import stored

CLUSTERS = 40
DIMS = 64
ROUNDS = 5
SCALE = 256
SALT = "2"
PIVOTS = 8  # 28 pairs
LARGEST = 1 << 19
SLACK = 2.0 ** -48  # of the products and the quotient of a bound: far above their rounding errors
BLOCK = 4096  # vectors bounded at a time


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (array of integers floor(scale * x)) of the kept vectors."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    whole = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def component(e: Column) -> Column:
        fits = F.abs(e) < float(LARGEST)
        return F.when(fits, F.floor(e * scale).cast("int")).otherwise(
            F.raise_error(F.lit(f"vector component of {LARGEST} or more")).cast("int"))

    return (table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(whole, F.lit(False)))
                 .select("vec_id", F.transform("x", component).alias("v")))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``salt:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` (few at a time) to all of ``b`` (few)."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, c in enumerate(b):
        diff = a - c
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


def choose_pivots(points: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Up to ``pivots`` distinct points: the first, then always the one farthest from those chosen."""
    if not len(points):
        return points
    chosen = [0]
    nearest = _squared(points, points[:1])[:, 0]
    while len(chosen) < pivots and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _squared(points, points[chosen[-1]:chosen[-1] + 1])[:, 0])
    return points[chosen]


@dataclass
class Pivots:
    """Centroids with what their bounds need."""

    pivots: np.ndarray
    centroids: np.ndarray

    def __post_init__(self):
        m = len(self.pivots)
        self.pairs = [(p, s) for p in range(m) for s in range(p + 1, m)]
        self.to_centroids = np.sqrt(_squared(self.centroids, self.pivots).astype(np.float64))
        self.between = np.sqrt(_squared(self.pivots, self.pivots).astype(np.float64))

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances; ``cached`` holds the vectors' distances to the pivots."""
        low = np.zeros((len(cached), len(self.centroids)))
        for p, s in self.pairs:
            a = cached[:, p, None] * (self.to_centroids[:, s] / self.between[p, s])
            b = cached[:, s, None] * (self.to_centroids[:, p] / self.between[p, s])
            gap = np.abs(a - b)
            gap -= (a + b) * SLACK
            np.maximum(low, gap, out=low)
        low *= low
        low *= 1 - SLACK
        return low

    def nearest(self, v: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, exact squared distance) of each vector, and how many exact comparisons it took."""
        n, k = len(v), len(self.centroids)
        low = self.bounds(cached)
        label = low.argmin(1)
        diff = v - self.centroids[label]
        best = np.einsum("ij,ij->i", diff, diff)
        first = label.copy()
        compared = n
        for j in range(k):
            # best is below 2**62; adding one part in 2**48 covers its own rounding to a double
            rows = np.flatnonzero((low[:, j] <= best * (1 + SLACK)) & (first != j))
            if not len(rows):
                continue
            compared += len(rows)
            diff = v[rows] - self.centroids[j]
            d = np.einsum("ij,ij->i", diff, diff)
            better = (d < best[rows]) | ((d == best[rows]) & (j < label[rows]))
            best[rows[better]] = d[better]
            label[rows[better]] = j
        return label, best, compared


def _matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, vectors, cached distances) in blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), _matrix(part.column(1), dims, np.int64), _matrix(part.column(2), pivots, np.float64)


def with_pivot_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, v, to_pivots``, written once."""

    def run(batches):
        for batch in batches:
            d = np.sqrt(_squared(_matrix(batch.column(1), pivots.shape[1], np.int64), pivots).astype(np.float64))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(d.ravel()))],
                names=["vec_id", "v", "to_pivots"])

    return stored(vectors.mapInArrow(run, "vec_id long, v array<int>, to_pivots array<double>"), "pivot-distances")


def cluster_sums(cached: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of each non-empty cluster; ``k`` rows reach the driver."""
    dims = centroids.shape[1]

    def run(batches):
        bounds = Pivots(pivots, centroids)
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for _, v, d in _blocks(batches, dims, len(pivots)):
            label = bounds.nearest(v, d)[0]
            order = np.argsort(label, kind="stable")
            used, first = np.unique(label[order], return_index=True)
            sums[used] += np.add.reduceat(v[order], first, axis=0)
            counts += np.bincount(label, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([[n, *s] for n, s in zip(counts[used].tolist(), sums[used].tolist())],
                                                  pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = cached.select("vec_id", "v", "to_pivots").mapInArrow(run, "cluster int, sums array<long>")
    total = (parts.select("cluster", F.posexplode("sums").alias("at", "x"))
                  .groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
                  .groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("sums")))
    return {r.cluster: (int(r.sums[0].x), [int(e.x) for e in r.sums[1:]]) for r in total.collect()}


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Every non-empty cluster's exact floor(sum / count); empty ones stay."""
    out = centroids.copy()
    for j, (n, total) in sums.items():
        out[j] = [s // n for s in total]
    return out


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT,
        pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """(table with cached pivot distances, pivots, final centroids) of ``integer_vectors``; None without vectors."""
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        return None
    fixed = choose_pivots(centroids, pivots)
    cached = with_pivot_distances(vectors, fixed)
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(cached, fixed, centroids))
    return cached, fixed, centroids


def assign(cached: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance, compared`` (exact comparisons of the row's block, shared out) of every vector."""

    def run(batches):
        bounds = Pivots(pivots, centroids)
        for ids, v, d in _blocks(batches, centroids.shape[1], len(pivots)):
            label, best, compared = bounds.nearest(v, d)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(label, pa.int32()), pa.array(best, pa.int64()), pa.array(np.full(len(v), compared / len(v)))],
                names=["vec_id", "cluster", "distance", "compared"])

    return cached.select("vec_id", "v", "to_pivots").mapInArrow(run, "vec_id long, cluster int, distance long, compared double")


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, k: int = CLUSTERS,
            rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """One row per kept vector: its cluster, squared distance, the inertias and its centroid's digest."""
    spark = table.sparkSession
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, "
              "centroid array<long>")
    fitted = fit(integer_vectors(table, id_col, vector_col, dims, scale), k, rounds, salt)
    if fitted is None:
        return spark.createDataFrame([], schema)
    cached, pivots, centroids = fitted
    rows = stored(assign(cached, pivots, centroids).drop("compared"), "assigned")
    inertia = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows at most
    per_cluster = spark.createDataFrame(
        [(j, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest(),
          centroids[j].tolist()) for j, d in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return rows.join(F.broadcast(per_cluster), "cluster").select([f.split()[0] for f in schema.split(", ")])
