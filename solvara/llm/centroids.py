"""Centroid clustering (12): Lloyd rounds over whole-number vectors with PCA-rotated filtering.

The principal axes of all vectors are found once.  Every vector is stored with its leading rotated coordinates and the
norm of what they leave over; the same is done with the centroids in each round.  As the rotation keeps distances,

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (residual(x) - residual(c))^2,

so a centroid whose bound lies above an exact distance already known cannot be the nearest.  The centroids that survive
are compared in whole numbers, and sums and means are whole numbers too: the result does not depend on the rotation, on
partitioning or on the order of additions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, python_tasks

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Rotated coordinates kept per vector; the others are known by their norm only.
LEADING = 16
#: Largest component after scaling: squared distances of up to 64 of them then fit in 64 bits.
LARGEST = 1 << 27
#: Share of |x|^2 + |c|^2 by which a bound may be off through rounding (it is off by about 1e-14).
ROUNDING = 1e-9


def finite_vector(vector: Column) -> Column:
    """True for a vector that is not null and holds no null and no non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; a vector with a component beyond LARGEST is an error."""
    scaled = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))))
    too_large = F.exists(vector, lambda x: F.abs(x * F.lit(float(scale))) >= LARGEST)
    return F.when(too_large, F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).otherwise(scaled)


def _stack(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def principal_axes(kept: DataFrame, dims: int, leading: int) -> np.ndarray:
    """The ``leading`` first principal axes (dims x leading) of all rows.

    Each task adds up its own rows' sums and products; Spark adds up the tasks.  Only dims * (dims + 1) numbers, whatever
    the row count, reach the driver.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims + 1, dims)), 0
        for b in batches:
            x = _stack(b.column(0), "<i4", dims).astype("f8")
            total[0] += x.sum(axis=0)
            total[1:] += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "m"])

    parts = kept.select("v").mapInArrow(moments, "n long, m array<double>")
    cells = parts.select("n", F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    found = sorted(cells.collect())
    n = max(1, found[0]["n"]) if found else 1
    total = np.array([r["x"] for r in found] or [0.0] * (dims * (dims + 1))).reshape(dims + 1, dims)
    mean = total[0] / n
    _, axes = np.linalg.eigh(total[1:] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :leading])


def rotated(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest."""
    x = x.astype("f8")
    lead = x @ axes
    return lead, np.linalg.norm(x - lead @ axes.T, axis=1)


def nearest(x: np.ndarray, lead: np.ndarray, residual: np.ndarray, centroids: np.ndarray,
            axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(cluster, squared distance, exact distances computed)``; ties go to the smaller cluster number."""
    c_lead, c_residual = rotated(centroids, axes)
    size = (lead**2).sum(axis=1) + residual**2
    c_size = (c_lead**2).sum(axis=1) + c_residual**2
    lower = np.empty((len(x), len(centroids)))
    for j in range(len(centroids)):
        lower[:, j] = ((lead - c_lead[j]) ** 2).sum(axis=1) + (residual - c_residual[j]) ** 2 - ROUNDING * (size + c_size[j])
    cluster = lower.argmin(axis=1)
    best = ((x - centroids[cluster]) ** 2).sum(axis=1)
    first, verified = cluster.copy(), len(x)
    for j in range(len(centroids)):
        rows = np.flatnonzero((lower[:, j] <= best) & (first != j))
        exact = ((x[rows] - centroids[j]) ** 2).sum(axis=1)
        verified += len(rows)
        better = (exact < best[rows]) | ((exact == best[rows]) & (j < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = exact[better], j
    return cluster, best, verified


@dataclass
class Clustering:
    """``assigned`` holds (vec_id, cluster, distance) of every kept vector; ``centroids`` the final whole numbers."""

    assigned: DataFrame
    centroids: list[list[int]]

    def summary(self) -> DataFrame:
        """``(cluster, n, cluster_inertia, centroid_sha256)`` of the clusters that have rows (as many as centroids at most)."""
        digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(self.centroids)]
        names = self.assigned.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
        sums = self.assigned.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia"))
        return sums.join(F.broadcast(names), "cluster")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE,
            seed: int = SEED, leading: int = LEADING, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Lloyd clustering of the vectors with exactly ``dims`` finite components, as floor(scale * x).

    Centroids start as the kept rows with the smallest sha256 of ``seed:id`` (ties: the smaller vector; null ids last),
    as many as there are if fewer than ``clusters``.  Every round assigns all rows (ties: smaller number) and replaces
    every centroid that has rows by the componentwise floor of their mean.  Rows are then assigned once more.  Repeated
    rows count each; an empty table has no centroid and no row; columns other than the two named are not read.
    """
    spark = vectors.sparkSession
    python_tasks(spark)
    kept = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(finite_vector(F.col("x")) & (F.size("x") == dims))
            .select("vec_id", whole_numbers(F.col("x"), scale).alias("w")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), dtype="<i4").reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], type=pa.binary())], names=["vec_id", "v"])

    whole = materialize(kept.mapInArrow(pack, "vec_id long, v binary"), "whole")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = whole.orderBy(key.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    schema = "vec_id long, cluster int, distance long"
    if not starts:
        return Clustering(spark.createDataFrame([], schema), [])
    centroids = np.array([np.frombuffer(r["v"], dtype="<i4") for r in starts], dtype="i8")
    axes = principal_axes(whole, dims, min(leading, dims))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, residual = rotated(_stack(b.column(1), "<i4", dims), axes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in lead], type=pa.binary()), pa.array(residual)],
                                             names=["vec_id", "v", "lead", "residual"])

    ready = materialize(whole.mapInArrow(rotate, "vec_id long, v binary, lead binary, residual double"), "rotated")

    def walk(batches, now):
        for b in batches:
            x = _stack(b.column(1), "<i4", dims).astype("i8")
            lead = _stack(b.column(2), "<f8", axes.shape[1])
            yield b.column(0), x, *nearest(x, lead, b.column(3).to_numpy(), now, axes)[:2]

    def totals(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(now), "i8"), np.zeros(now.shape, "i8")
            for _, x, j, _ in walk(batches, now):
                n += np.bincount(j, minlength=len(now))
                for one in np.unique(j):
                    total[one] += x[j == one].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now), dtype="i4")), pa.array(n), pa.array(total.tolist(), type=pa.list_(pa.int64()))],
                                             names=["cluster", "n", "total"])
        return run

    for _ in range(rounds):
        parts = ready.mapInArrow(totals(centroids), "cluster int, n long, total array<long>")
        sums = (parts.where("n > 0").select("cluster", "n", F.posexplode("total").alias("i", "x"))
                .groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")))
        for r in sums.collect():  # clusters x dims numbers, whatever the row count
            centroids[r["cluster"], r["i"]] = int(r["x"]) // r["n"]

    final = centroids.copy()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, j, distance in walk(batches, final):
            yield pa.RecordBatch.from_arrays([ids, pa.array(j.astype("i4")), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return Clustering(materialize(ready.mapInArrow(assign, schema), "assigned"), final.tolist())
