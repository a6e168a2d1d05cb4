"""Exact cosine search over a table of vectors, or over lists of them that can be skipped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.errors import RetrieveError, StoreError
from millrace.functions import text as t

#: Queries that one job sends to every task; rows of a tile or a shard beyond that; scores that
#: a task holds at once.
MOST_QUERIES, TILE, SCORES = 4096, 8192, 1 << 21


def checked(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    """Fails, when rows are read, on a vector of another number of components; null is none."""
    right = F.col(column).isNull() | (F.size(column) == dimension)
    return vectors.withColumn(column, F.when(right, F.col(column)).otherwise(F.raise_error(F.lit(f"vectors must have {dimension} components")).cast(vectors.schema[column].dataType)))


def has_direction(query: list[float]) -> bool:
    """Whether a vector can be compared by cosine: it has a length, and that is finite."""
    return bool(np.isfinite(query).all() and np.any(query))


def cosine_topk(vectors: DataFrame, key: str, column: str, query: list[float], k: int = 10, where: Column | None = None, places: int = 9) -> DataFrame:
    """key and score of the k rows nearest to one vector; ties go to the smaller key.

    A condition on rows is applied before the search, so it can prune the scan. Null vectors,
    those of length zero and those with null or non-finite components have no score and are
    left out, and a query vector of length zero finds nothing. A vector of another number of
    components fails the search.
    """
    asked_for(query, k)
    rows = checked(vectors if where is None else vectors.filter(where), column, len(query))
    asked = F.array(*(F.lit(float(x)) for x in query))
    score = F.round(t.cosine(F.col(column), asked), places)
    scored = rows.filter(F.col(column).isNotNull() & F.lit(has_direction(query))).select(key, score.alias("score"))
    return scored.filter(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), key).limit(k)


def asked_for(query: list[float], k: int) -> None:
    if k < 1:
        raise RetrieveError("k must be at least 1", {"k": k})
    if not query:
        raise StoreError("a query vector needs components")


def _best(ids: np.ndarray, q: np.ndarray, own: pa.Array, x: np.ndarray, k: int, places: int, with_own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, rows and scores, some unit queries at a time: of each query's rows the k best, ties to smaller keys."""
    by_key = pc.sort_indices(own, null_placement="at_start").to_numpy()
    own, x = own.to_numpy(zero_copy_only=False)[by_key], _unit(x[by_key])
    keep, step = min(k, len(own)), max(1, SCORES // len(own))
    for i in range(0, len(q), step):
        with np.errstate(all="ignore"):
            score = np.round(q[i : i + step] @ x.T, places)
        score[~np.isfinite(score)] = -np.inf
        if not with_own:
            score[ids[i : i + step, None] == own[None, :]] = -np.inf
        edge = np.partition(score, len(own) - keep, axis=1)[:, len(own) - keep]
        row, col = np.nonzero((score >= edge[:, None]) & np.isfinite(score))
        tied = score[row, col] == edge[row]
        ties, free = row[tied], keep - np.bincount(row[~tied], minlength=len(score))
        tied[tied] = np.arange(len(ties)) - np.searchsorted(ties, ties) >= free[ties]  # those that come too late
        row, col = row[~tied], col[~tied]
        yield ids[i : i + step][row], own[col], score[row, col]


def _rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, null components as not a number; all have as many components."""
    each = column.value_lengths().to_numpy(zero_copy_only=False)
    width = width or (int(each[0]) if len(each) else 1)
    if (each != width).any():
        raise ValueError(f"vectors must have {width} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _unit(q: np.ndarray) -> np.ndarray:
    """Rows of length one; a row without direction scores nothing."""
    with np.errstate(all="ignore"):
        return q / np.sqrt((q * q).sum(axis=1, keepdims=True))


def cosine_topk_batch(vectors: DataFrame, key: str, column: str, queries: DataFrame, k: int = 10, places: int = 9, most: int = MOST_QUERIES, own: bool = False, tile: int = TILE) -> DataFrame:
    """query_id, key, score and rank for each row (query_id, vector) of ``queries``.

    Up to ``most`` queries are sent to every task, where each batch of rows is one matrix
    product, of which k rows for each query go on. More of them are dealt into tiles and the
    rows into shards of at most about ``tile`` each, and each tile meets each shard in a group of
    its own. A window ranks what is left. A row with the query's own id is left out, unless ``own`` asks for it too, as where
    queries are no rows. Vectors without a score are left out as in ``cosine_topk``, also as queries.
    """
    kind = vectors.schema[key].dataType.simpleString()
    vectors, queries = vectors.filter(F.col(column).isNotNull()), queries.filter(F.col("vector").isNotNull())
    asked = queries.select("query_id", "vector").limit(most + 1).collect()
    shape = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {kind}, score double"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    if len(asked) > most:
        found = _tiled(vectors.select(F.col(key).alias("key"), F.col(column).alias("x")), queries, key, k, places, tile, shape, own)
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)
    ids = pa.array([r[0] for r in asked]).to_numpy(zero_copy_only=False) if asked else np.zeros(0, np.int64)
    q = _unit(_rows(pa.array([r[1] for r in asked], pa.list_(pa.float64())))) if asked else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) and len(ids):
                for found in _best(ids, q, batch.column(0), _rows(batch.column(1), q.shape[1]), k, places, own):
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in found], names=["query_id", key, "score"])

    return vectors.select(key, column).mapInArrow(run, shape).withColumn("rank", rank).filter(F.col("rank") <= k)


def _tiled(rows: DataFrame, queries: DataFrame, key: str, k: int, places: int, tile: int, shape: str, with_own: bool) -> DataFrame:
    tiles, shards = (-(-frame.count() // tile) for frame in (queries, rows))
    dealt, shard = F.pmod(F.xxhash64("query_id"), F.lit(tiles)), F.pmod(F.xxhash64("key"), F.lit(max(1, shards)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long")))
    asked = queries.select(dealt.alias("tile"), every(shards).alias("shard"), "query_id", "vector")
    held = rows.select(shard.alias("shard"), every(tiles).alias("tile"), "key", "x")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = (_rows(t.combine_chunks().column(c).combine_chunks()) if len(t) else np.zeros((0, 1)) for t, c in ((left, "vector"), (right, "x")))
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(x):
            out += _best(left["query_id"].to_numpy(), _unit(q), right.combine_chunks()["key"].combine_chunks(), x, k, places, with_own)
        return pa.table({name: pa.array(np.concatenate([o[i] for o in out])) for i, name in enumerate(("query_id", key, "score"))})

    return asked.groupBy("tile", "shard").cogroup(held.groupBy("tile", "shard")).applyInArrow(meet, shape)


#: What an angle may be off by, as arccos is steep near its ends.
ANGLE_SLACK = 1e-6


class Lists:
    """Vectors stored in lists around centres, for exact search that skips lists.

    Every vector goes to the centre of the smallest angle; a list's least and largest angle are
    kept. By the triangle inequality of angles, a query at angle a from a centre finds nothing
    in its list that is nearer than a minus the largest, or the least minus a. The k-th score
    of the nearest lists then leaves out all lists whose bound is lower."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def write(self, rows: DataFrame, column: str, dimension: int, lists: int = 256) -> Lists:
        """Stores the rows that have a direction; at most ``lists`` of them are centres. A vector
        of another number of components fails the write."""
        x = F.col(column).cast("array<double>")
        directed = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
        kept = checked(rows, column, dimension).select(self.key, x.alias("x")).filter(F.col("x").isNotNull()).filter(directed)
        chosen = kept.orderBy(F.xxhash64(F.lit(11), self.key), self.key).limit(lists).select("x").collect()
        centres = _unit(np.array([r[0] for r in chosen], np.float64).reshape(-1, dimension))
        key, kind = self.key, kept.schema[self.key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _unit(_rows(batch.column(1), dimension)) @ centres.T if len(batch) else np.zeros((0, 1))
                own = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(near)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(angle)], names=[key, "x", "list", "angle"])

        placed = kept.mapInArrow(run, f"{self.key} {kind}, x array<double>, list int, angle double")
        placed.repartition("list").write.partitionBy("list").parquet(f"{self.path}/vectors")
        stored = self.spark.read.parquet(f"{self.path}/vectors").groupBy("list").agg(F.min("angle").alias("least"), F.max("angle").alias("largest"), F.count("*").alias("n"))
        centre = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
        centre.join(stored, "list").coalesce(1).write.parquet(f"{self.path}/centres")
        return self

    def _bounds(self, query: list[float]) -> list[tuple[float, float, int, int]]:
        """Of each list, nearest centre first: its angle, its best score at most, number and rows."""
        rows = self.spark.read.parquet(f"{self.path}/centres").collect()  # as many as lists
        if not rows:
            return []
        if len(rows[0].centre) != len(query):
            raise StoreError(f"vectors must have {len(rows[0].centre)} components", {"given": len(query)})
        angle = np.arccos(np.clip(np.array([r.centre for r in rows]) @ _unit(np.array([query], np.float64))[0], -1, 1))
        gap = np.maximum(0, np.maximum(angle - [r.largest for r in rows], np.array([r.least for r in rows]) - angle) - ANGLE_SLACK)
        return sorted((float(a), float(b), r.list, r.n) for a, b, r in zip(angle, np.cos(gap), rows))

    def _of(self, lists: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors").filter(F.col("list").isin(lists)).drop("list", "angle")

    def needed(self, query: list[float], k: int, places: int = 9) -> list[int]:
        """The lists that can hold one of the k nearest rows."""
        asked_for(query, k)
        if not has_direction(query) or not (bounds := self._bounds(query)):
            return []
        first, held = [], 0
        for _, _, number, n in bounds:
            first.append(number)
            held += n
            if held >= k:
                break
        found = cosine_topk(self._of(first), self.key, "x", query, k, places=places).collect()
        least = found[-1].score - 10.0**-places if len(found) == k else -2.0
        return [number for _, bound, number, _ in bounds if bound >= least]

    def search(self, query: list[float], k: int = 10, places: int = 9) -> DataFrame:
        """As ``cosine_topk`` over all stored rows."""
        return cosine_topk(self._of(self.needed(query, k, places)), self.key, "x", query, k, places=places)
