"""Operator 13: centroid clustering over an incremental distance matrix.

Components become floor(scale * x), and all arithmetic after that is exact. With each vector
goes its row of the distance matrix: the integer inner products with all centroids. A round
does not take these anew; it adds, for each centroid, what its changed components add (the
first round starts from centroids of zeros), and then takes the nearest of |c|^2 - 2 x.c.
A round is one job: tasks bring their rows up to date, keep them as Spark's persisted
blocks, and send on one row for each cluster and component, so that the driver sees
clusters times components. Blocks of an executor that is lost are made again from the
vectors and the few changes of each round, which are part of the plan.

Defined results: vectors of other lengths, null ones and those with null or non-finite
components take no part; components of ``MOST`` and more after scaling fail, as distances
would not fit a long. Fewer vectors than centroids give one centroid for each vector. A
centroid without vectors stays. Ties go to the smaller cluster number. Repeated rows are
vectors of their own, also as first centroids, whose ties go to the smaller id and then to
the smaller components; a null vec_id hashes like an empty one. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint

#: Scaled components are smaller: 64 products of two, doubled, fit a long with room to spare.
MOST = 1 << 27


def whole_vectors(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """vec_id and x (array<int>) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(1).flatten().to_numpy() * scale)
            if len(x) and np.abs(x).max() >= MOST:
                raise ValueError(f"scaled components must be below {MOST}")
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x.astype(np.int32), dims)], names=["vec_id", "x"])

    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") == dims) & finite)
    return kept.mapInArrow(run, "vec_id long, x array<int>")


def _lists(values: np.ndarray, each: int) -> pa.ListArray:
    flat = np.ascontiguousarray(values).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, each, dtype=np.int32)), pa.array(flat))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _updated(change: np.ndarray, norms: np.ndarray, dims: int):
    """Rows with their inner products after ``change`` of the centroids, and the nearest one."""
    k = len(change)
    changed = [np.flatnonzero(row) for row in change]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims).astype(np.int64)
            dots = _matrix(batch.column(2), k).copy() if batch.num_columns > 2 else np.zeros((len(x), k), np.int64)
            for c, at in enumerate(changed):
                if len(at):
                    dots[:, c] += x[:, at] @ change[c, at]
            apart = norms - 2 * dots
            nearest = apart.argmin(axis=1)  # the first of equals
            distance = apart[np.arange(len(x)), nearest] + (x * x).sum(axis=1)
            columns = [batch.column(0), batch.column(1), _lists(dots, k), pa.array(nearest.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "dots", "cluster", "distance"])

    return run


STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"


def _totals(k: int, dims: int):
    """Of a task one row for each cluster and component, with the number of vectors as the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x, cluster = _matrix(batch.column(1), dims).astype(np.int64), batch.column(0).to_numpy()
            for c in np.unique(cluster):
                own = x[cluster == c]
                total[c, :dims] += own.sum(axis=0)
                total[c, dims] += len(own)
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[c, at])], names=["cluster", "component", "total"])

    return run


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in ascending order of these."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = kept.select(hashed.alias("hash"), "vec_id", "x").orderBy("hash", "vec_id", "x").limit(k).collect()
    return np.array([row.x for row in chosen], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of
    every vector that takes part, after ``rounds`` of assignment and update and a last
    assignment."""
    kept = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.limit(0).selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    k = len(centroids)
    change, state, held = centroids, kept, None
    for _ in range(rounds):
        state = state.mapInArrow(_updated(change, (centroids * centroids).sum(axis=1), dims), STATE).persist(StorageLevel.MEMORY_AND_DISK)
        sums = state.select("cluster", "x").mapInArrow(_totals(k, dims), "cluster int, component int, total long")
        total = [[0] * (dims + 1) for _ in range(k)]
        for row in sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            total[row.cluster][row.component] = int(row.total)
        if held is not None:
            held.unpersist()
        held = state
        moved = np.array([[s // t[dims] for s in t[:dims]] if t[dims] else was for t, was in zip(total, centroids.tolist())], np.int64)
        change, centroids = moved - centroids, moved
        if not change.any():  # later rounds would find the same
            break
    last = checkpoint(state.mapInArrow(_updated(change, (centroids * centroids).sum(axis=1), dims), STATE).select("vec_id", "cluster", "distance"))
    if held is not None:
        held.unpersist()
    own = {row.cluster: int(row.total) for row in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cluster") + 1)
    inertia = F.lit(sum(own.values())).cast("long")
    return last.select("*", of([own.get(c, 0) for c in range(k)]).cast("long").alias("cluster_inertia"), inertia.alias("inertia"), of(digest).alias("centroid_sha256"))
