"""Centroid clustering of integer vectors behind N-simplex bounds.

A few pivots span a simplex. The distances of a vector to the pivots are
computed once and kept as the coordinates of the apex over that simplex: all
coordinates but the last lie in the span of the pivots, the last is the height
over it. Two apexes on the same side of the span are never farther apart than
their vectors, two on opposite sides never nearer, so the bounds leave few
centroids of each vector for the exact comparison in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.session import local_frame, materialise

DIMS, SCALE = 64, 64
CLUSTERS, ROUNDS = 16, 3
PIVOTS = 12
# Components beyond this count as this, so that squared distances fit 64 bits.
LARGEST = 1 << 27
_ROWS = 1 << 13
_MOST = (1 << 63) - 1


class Simplex:
    """Pivots among ``points`` and the coordinates of any vector over them.

    The next pivot is the point highest over the simplex so far; points in its
    span add nothing and are left out.
    """

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        chosen = [0] if len(points) else []
        heights = _squared(points, points[:1])[:, 0].astype(np.float64) if len(points) else np.zeros(0)
        self._set(points[chosen])
        while chosen and len(chosen) < most and heights.max() >= 1:
            chosen.append(int(heights.argmax()))
            self._set(points[chosen])
            heights = self.apexes(points)[:, -1] ** 2
        self.chosen = chosen

    def _set(self, pivots: np.ndarray) -> None:
        n = len(pivots)
        self.pivots = pivots
        between = _squared(pivots, pivots).astype(np.float64)
        base = np.zeros((n, max(n - 1, 0)))
        for k in range(1, n):
            solved = (between[k, 0] - between[k, 1:k] + (base[1:k] ** 2).sum(axis=1)) / 2
            base[k, : k - 1] = np.linalg.solve(base[1:k, : k - 1], solved) if k > 1 else 0
            base[k, k - 1] = np.sqrt(max(between[k, 0] - (base[k, : k - 1] ** 2).sum(), 0))
        self.norms = (base[1:] ** 2).sum(axis=1)
        self.solve = np.linalg.inv(base[1:]).T if n > 1 else np.zeros((0, 0))

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates from the distances to the pivots; the last is the height."""
        to = _squared(vectors, self.pivots).astype(np.float64)
        flat = ((to[:, :1] - to[:, 1:] + self.norms) / 2) @ self.solve
        height = np.sqrt(np.maximum(to[:, :1] - (flat**2).sum(axis=1, keepdims=True), 0))
        return np.concatenate([flat, height], axis=1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to the few rows of ``b``."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    for k, row in enumerate(b):
        apart = a - row
        out[:, k] = np.einsum("ij,ij->i", apart, apart)
    return out


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), its squared distance, and how many were compared exactly."""
    size = (apexes**2).sum(axis=1)[:, None] + (tops**2).sum(axis=1)[None, :]
    # Differences column by column: the expanded square would cancel digits.
    lower = np.zeros((len(apexes), len(tops)))
    for k in range(apexes.shape[1] - 1):
        lower += (apexes[:, k, None] - tops[None, :, k]) ** 2
    upper = lower + (apexes[:, -1, None] + tops[None, :, -1]) ** 2
    lower += (apexes[:, -1, None] - tops[None, :, -1]) ** 2
    slack = 1e-7 * size + 1e-6
    row, column = np.nonzero(lower - slack <= (upper + slack).min(axis=1, keepdims=True))
    apart = vectors[row] - centroids[column]
    exact = np.full(lower.shape, _MOST, dtype=np.int64)
    exact[row, column] = np.einsum("ij,ij->i", apart, apart)
    best = exact.argmin(axis=1)
    return best, exact[np.arange(len(best)), best], len(row)


def integers(vectors: DataFrame, column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` of the rows with exactly ``dims`` finite components, each as floor(scale * x).

    Rows that are null, shorter or longer, or hold a null, NaN or infinite
    component are left out. Repeated rows stay.
    """
    x = F.col(column).cast("array<double>")
    most = F.lit(float(LARGEST))
    whole = (F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, most), -most)).cast("int"))
    return vectors.where(F.col(column).isNotNull() & whole).select(F.col("vec_id"), v.alias("v"))


def _start(kept: DataFrame, k: int, dims: int) -> np.ndarray:
    """The ``k`` vectors with the smallest digests of their id, in that order."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), dims)


def _batch(batch: pa.RecordBatch, dims: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    def flat(name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False)

    return flat("v").astype(np.int64).reshape(-1, dims), flat("apex").reshape(-1, wide)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield batch.slice(k, _ROWS)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, column: str = "embedding", dims: int = DIMS, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that ``integers`` keeps.

    The first centroids are the ``k`` vectors with the smallest digests of
    their id, or all if there are fewer. Each round assigns every vector to the
    nearest centroid (ties: the smaller number) and moves every centroid with
    vectors to the floor of their mean; then vectors are assigned once more.
    Repeated rows and ids are vectors of their own; no vectors, no rows; other
    columns are not read. Only centroids and their sums reach the driver.
    """
    spark = vectors.sparkSession
    kept = materialise(integers(vectors, column, dims, scale), "vectors")
    centroids = _start(kept, k, dims)
    if not len(centroids):
        schema = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return kept.select("vec_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", "))).limit(0)
    simplex = Simplex(centroids, pivots)
    wide = len(simplex.chosen)

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            apex = pa.FixedSizeListArray.from_arrays(pa.array(simplex.apexes(v).reshape(-1)), wide).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), apex], names=["vec_id", "v", "apex"])

    id_type = kept.schema["vec_id"].dataType.simpleString()
    lifted = materialise(kept.mapInArrow(lift, f"vec_id {id_type}, v array<int>, apex array<double>"), "apexes")

    for _ in range(rounds):
        centroids = _moved(lifted, centroids, simplex.apexes(centroids), dims, wide)

    tops = simplex.apexes(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            best, distance, _ = nearest(*_batch(batch, dims, wide), centroids, tops)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = materialise(lifted.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance bigint"), "assigned")
    # Exact sums; a sum beyond 64 bits counts as the largest.
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    everything = min(sum(sums.values()), _MOST)
    rows = [(c, min(s, _MOST), everything, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    ends = local_frame(spark, rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(lifted: DataFrame, centroids: np.ndarray, tops: np.ndarray, dims: int, wide: int) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; one without vectors stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims + 1), dtype=np.int64)
        for batch in _parts(batches):
            vectors, apexes = _batch(batch, dims, wide)
            best, _, _ = nearest(vectors, apexes, centroids, tops)
            order = np.argsort(best, kind="stable")
            there, first = np.unique(best[order], return_index=True)
            total[there, :dims] += np.add.reduceat(vectors[order], first, axis=0)
            total[:, dims] += np.bincount(best, minlength=len(total))
        some = np.flatnonzero(total[:, dims])
        at = np.tile(np.arange(dims + 1), len(some))
        columns = [pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(at, pa.int32()), pa.array(total[some].reshape(-1))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "at", "total"])

    parts = lifted.mapInArrow(sums, "cluster int, at int, total bigint")
    rows = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {(r.cluster, r.at): int(r.total) for r in rows}
    new = centroids.copy()
    for c in {c for c, _ in totals}:
        new[c] = [totals[c, d] // totals[c, dims] for d in range(dims)]
    return new
