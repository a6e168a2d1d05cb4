"""Operator 3: exact top-k by tiled matrix products.

Queries are dealt to tiles and candidates to shards, both by a hash of the id. Every pair
of tile and shard is a task: it multiplies the two matrices block by block and keeps each
query's k best. The lists of a tile are then merged ``FAN`` shards at a time until one is
left, so no task holds more than a tile and a shard, or ``FAN`` lists for each query.

Components become floor(scale * x). Products are taken in the narrowest arithmetic that is
exact for the numbers at hand: 32-bit floats below 2**24, 64-bit ones below 2**53, else
Python integers.

Defined results: vectors that are null or hold null or non-finite components, and rows
whose id is null, take no part; vectors of different lengths do not score against each
other; a candidate with the query's own id is the query's own. Repeated query rows each
give a list under the same id. Ties go to the smaller vec_id. A query without candidates
and an empty table give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE, SHARD, FAN = 4096, 32768, 16
#: Queries whose products with a shard are held at a time.
BLOCK = 64
LISTS = "tile int, shard int, row long, query_id long, vec_id long, score long"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select("vec_id", x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(finite)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    bound = q.shape[1] * max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(c).max(initial=0)))
    if bound < 2**24:
        return q.astype(np.float32), c.astype(np.float32), True
    if bound < 2**53:
        return q, c, True
    whole = np.frompyfunc(int, 1, 1)
    return whole(q), whole(c), False


def _best(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best of candidates that are in order of id: its number, ids and scores."""
    q, c, small = _exact(q, c)
    n = len(ids)
    for at in range(0, len(q), BLOCK):
        product = q[at : at + BLOCK] @ c.T
        same = np.searchsorted(ids, own[at : at + BLOCK]), np.searchsorted(ids, own[at : at + BLOCK], "right")
        for i in range(len(product)):
            score = product[i]
            allowed = n - (same[1][i] - same[0][i])
            keep = min(k, allowed)
            if not keep:
                continue
            if small:
                score = score.astype(np.int64)
                lowest = np.iinfo(np.int64).min
                score[same[0][i] : same[1][i]] = lowest
                edge = np.partition(score, n - keep)[n - keep]
                above = np.flatnonzero(score > edge)
                level = np.flatnonzero(score == edge)[: keep - len(above)]
                picked = np.concatenate([above, level])
                picked = picked[np.lexsort((picked, -score[picked]))]
            else:
                rows = [j for j in range(n) if not same[0][i] <= j < same[1][i]]
                picked = np.array(sorted(rows, key=lambda j: (-score[j], j))[:keep])
            yield at + i, ids[picked], np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in score[picked]], np.int64)


def _lists(tile, shard, rows: np.ndarray, queries: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    each = np.array([len(f[1]) for f in found], np.int64)
    at = np.repeat(np.array([f[0] for f in found], np.int64), each) if found else np.zeros(0, np.int64)
    join = lambda i: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)
    n = len(at)
    return pa.table({"tile": pa.array(np.full(n, tile, np.int32)), "shard": pa.array(np.full(n, shard, np.int32)), "row": pa.array(rows[at]), "query_id": pa.array(queries[at]), "vec_id": pa.array(join(1)), "score": pa.array(join(2))})


def search(queries: DataFrame, candidates: DataFrame, k: int, scale: float = 64.0, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score: for each query row its k best of all candidates."""
    whole = lambda df: valid(df).withColumn("x", F.transform("x", lambda v: _floor(v * scale)))
    q, c = whole(queries), whole(candidates)
    tiles, shards = max(1, -(-q.count() // tile)), max(1, -(-c.count() // shard))
    q = q.withColumn("row", F.row_number().over(Window.partitionBy("vec_id").orderBy("x")).cast("long"))  # tells rows of one id apart
    q = q.select(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "row", "x")
    c = c.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", F.lit(0).cast("long").alias("row"), "x")

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        at, number = key[0].as_py(), key[1].as_py()
        out = []
        sizes = pa.compute.list_value_length(table["x"]).to_numpy()
        for size in np.unique(sizes):
            own = table.filter(pa.array(sizes == size))
            ids, x = own["vec_id"].to_numpy(), _matrix(own["x"])
            asks = own["asks"].to_numpy()
            order = np.argsort(ids[~asks], kind="stable")
            asked = np.argsort(ids[asks], kind="stable")
            mine = ids[asks][asked]
            copy = own["row"].to_numpy()[asks][asked]
            if len(order) and len(mine):
                out.append(_lists(at, number, copy, mine, list(_best(x[asks][asked], x[~asks][order], mine, ids[~asks][order], k))))
        return pa.concat_tables(out) if out else _lists(at, number, np.zeros(0, np.int64), np.zeros(0, np.int64), [])

    import pyarrow.compute  # noqa: F401

    lists = q.unionByName(c).groupBy("tile", "shard").applyInArrow(cell, LISTS)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        row, query, vec, score = (table[n].to_numpy() for n in ("row", "query_id", "vec_id", "score"))
        order = np.lexsort((vec, -score, row, query))
        query_o, row_o = query[order], row[order]
        new = np.concatenate([[True], (query_o[1:] != query_o[:-1]) | (row_o[1:] != row_o[:-1])])
        rank = np.arange(len(order)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(order))))
        kept = order[rank < k]
        return pa.table({"tile": pa.array(np.full(len(kept), key[0].as_py(), np.int32)), "shard": pa.array(np.full(len(kept), key[1].as_py(), np.int32)), "row": row[kept], "query_id": query[kept], "vec_id": vec[kept], "score": score[kept]})

    while shards > 1:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")).groupBy("tile", "shard").applyInArrow(merge, LISTS)
        shards = -(-shards // FAN)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            query, row = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ranks = []
            for pair in zip(query, row):
                rank = rank + 1 if pair == last else 1
                last = pair
                ranks.append(rank)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranks, pa.int32()), batch.column(2), batch.column(3)], names=["query_id", "rank", "vec_id", "score"])

    # a tile's lists come whole and in order from the task that made them
    return lists.select("query_id", "row", "vec_id", "score").mapInArrow(number, "query_id long, rank int, vec_id long, score long")


def _floor(v: Column) -> Column:
    """floor as a double, also beyond the range of long."""
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)
