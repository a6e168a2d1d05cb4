"""Operator 7: approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are made unit length, so the largest cosine is the least distance. Lists come from
k-means on a bounded sample (``SAMPLE`` rows by the order of a hash of the id); every row
is put into the list of its nearest centre. A query probes its nearest lists: as many as
held ``RECALL`` of the true neighbours of ``ASKED`` sample rows within the sample, and as
many more as it takes to hold ``k + 1`` rows. Neighbouring lists form groups of about the
same number of rows (a larger list is cut into several groups), and a query is sent once to
each group that holds one of its lists, not once to each list. In a group all vectors are
turned by one random rotation, and each list that the query probes is scanned in blocks of
columns: after each block a candidate is given up when its partial distance is larger than
the query's k-th best so far allows at the significance of the test (the partial sum over d
of D rotated dimensions estimates the whole distance with an error of about 1 / sqrt(d)).
Candidates that are left are scored exactly on the original vectors in double precision; a
group returns k for each query, and these are merged.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows whose id is null or vectors of another length than most of the sample
has; a candidate with the query's own id is the query's own; of a query id's several vectors
the smallest is asked, and a candidate id counts by its best vector. Equal vectors are scanned
once for all their ids, so ties go to the smaller vec_id. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint

SAMPLE = 20_000
#: Sample rows for each list at least; more rows of the table make lists longer.
SAMPLE_A_LIST = 4
#: Fewest and most rows of a group, and groups of a table that fills neither bound.
GROUP_ROWS, GROUPS = (512, 65_536), 24
ASKED = 512
RECALL = 0.97
COLUMNS = 16
#: Standard errors that a partial distance must lie above before it is given up.
SIGNIFICANCE = 2.1
#: Candidates with distances this close to the k-th are scored exactly as well.
SLACK = 1e-5
SEED = 9


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and x (floats, or else doubles) of the rows that take part."""
    x = F.col("embedding")
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        x = x.cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    return vectors.select("vec_id", x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(finite)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """k-means on unit vectors; an empty list keeps its centre."""
    rng = np.random.default_rng(SEED)
    own = sample[rng.permutation(len(sample))[:n]].astype(np.float32)
    sample = sample.astype(np.float32)
    for _ in range(rounds):
        of = np.concatenate([(sample[i : i + 4096] @ own.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(own)
        np.add.at(total, of, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        own = np.where(size > 1e-6, total / np.maximum(size, 1e-6), own)
    return own


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + 1).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def probes_needed(sample: np.ndarray, means: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Lists to probe so that this share of the k nearest of some sample rows is in them."""
    asked = sample[:ASKED].astype(np.float32)
    if len(sample) < 2:
        return len(means)
    near = asked @ sample.astype(np.float32).T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    of = np.concatenate([(sample[i : i + 4096].astype(np.float32) @ means.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
    rank = np.argsort(np.argsort(-(asked @ means.T), axis=1, kind="stable"), axis=1)
    return 1 + int(np.quantile(np.take_along_axis(rank, of[best], axis=1), recall, method="higher"))


def _cosines(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows get equal scores."""
    return (x * a).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((a * a).sum()))


def adaptive_scan(q: np.ndarray, c: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, columns: int = COLUMNS) -> list[np.ndarray]:
    """For each rotated query the rows of ``c`` that may be among its k nearest, without row
    ``own``; ``limit`` is the squared distance of its k-th best so far."""
    n, d = c.shape
    at = min(columns, d)
    partial = (q[:, :at] ** 2).sum(axis=1)[:, None] + (c[:, :at] ** 2).sum(axis=1)[None, :] - 2 * (q[:, :at] @ c[:, :at].T)
    bar = lambda seen: np.where(np.isinf(limit), np.inf, limit * seen / d * (1 + SIGNIFICANCE / np.sqrt(seen)) ** 2 + SLACK) if seen < d else limit + SLACK
    i, j = np.nonzero(partial <= bar(at)[:, None])
    keep = own[i] != j
    i, j = i[keep], j[keep]
    far = partial[i, j]
    while at < d and len(i):
        to = min(at + columns, d)
        gap = q[i, at:to] - c[j, at:to]
        far = far + np.einsum("ij,ij->i", gap, gap)
        at = to
        keep = far <= bar(at)[i]
        i, j, far = i[keep], j[keep], far[keep]
    order = np.lexsort((far, i))
    i, j, far = i[order], j[order], far[order]
    ends = np.searchsorted(i, np.arange(len(q) + 1))
    out = []
    for row in range(len(q)):
        mine, dist = j[ends[row] : ends[row + 1]], far[ends[row] : ends[row + 1]]
        out.append(mine[: np.searchsorted(dist, dist[k - 1] + SLACK, "right")] if len(mine) > k else mine)
    return out


def grouped(sizes: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first group and how many it is cut into; lists of one group are neighbours."""
    most = int(np.clip(sizes.sum() // GROUPS, *GROUP_ROWS))
    coarse = centres(means, max(1, int(np.ceil(np.sqrt(len(means))))))
    first, parts = np.zeros(len(sizes), np.int32), np.maximum(1, -(-sizes // most)).astype(np.int32)
    group, held = 0, 0
    for lst in np.argsort((means @ coarse.T).argmax(axis=1), kind="stable"):
        if held and (held + sizes[lst] > most or parts[lst] > 1):
            group, held = group + 1, 0
        first[lst] = group
        held += int(sizes[lst])
        if parts[lst] > 1:
            group, held = group + int(parts[lst]), 0
    return first, parts


def _merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to the smaller id, each id by its best score."""
    order = np.lexsort((ids, -scores))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
    return scores[order], ids[order]


def scanner(means: np.ndarray, k: int):
    """Scans a group: rows of list -1 are queries, with the similarity of the farthest centre that they probe."""
    d = means.shape[1]
    turn = rotation(d)

    def scan(table: pa.Table) -> pa.Table:
        of, ids, x, bound = table["list"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["x"]), table["bound"].to_numpy()
        asks = np.flatnonzero(of < 0)
        q, q_ids, bound = x[asks], ids[asks], bound[asks]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        limit = np.full(len(q), np.inf, np.float32)
        turned_q = (_unit(q) @ turn).astype(np.float32) if len(q) else q
        unit_q = _unit(q).astype(np.float32) if len(q) else q
        order = np.lexsort((ids, of))
        order = order[len(asks) :]
        cuts = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(order) and len(q) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            rows = order[a:b]
            probing = np.flatnonzero(unit_q @ means[of[rows[0]]] >= bound - 1e-6)
            if not len(probing):
                continue
            c, c_ids = x[rows], ids[rows]
            # equal vectors are one row with all of its ids, in order
            whole = np.ascontiguousarray(c).view(np.dtype((np.void, d * 8))).ravel()
            _, head, same = np.unique(whole, return_index=True, return_inverse=True)
            by = np.argsort(same, kind="stable")
            ends = np.searchsorted(same[by], np.arange(len(head) + 1))
            one = c[head]
            turned = (_unit(one) @ turn).astype(np.float32)
            sole = np.diff(ends) == 1
            for at in range(0, len(probing), 64):
                mine = probing[at : at + 64]
                place = np.minimum(np.searchsorted(c_ids, q_ids[mine]), len(c_ids) - 1)
                own = np.where((c_ids[place] == q_ids[mine]) & sole[same[place]], same[place], -1)
                for i, picked in zip(mine.tolist(), adaptive_scan(turned_q[mine], turned, own, limit[mine], k)):
                    found, named = [best[i][0]], [best[i][1]]
                    for score, p in zip(_cosines(one[picked], q[i]).tolist(), picked.tolist()):
                        copies = np.unique(c_ids[by[ends[p] : ends[p + 1]]])
                        copies = copies[copies != q_ids[i]][:k]
                        found.append(np.full(len(copies), score))
                        named.append(copies)
                    best[i] = _merged(np.concatenate(found), np.concatenate(named), k)
                    if len(best[i][0]) == k:
                        limit[i] = max(0.0, 2 - 2 * best[i][0][-1])
        each = [len(s) for s, _ in best]
        scores, named = (np.concatenate([b[j] for b in best]) if best else np.zeros(0) for j in (0, 1))
        return pa.table({"query_id": pa.array(np.repeat(q_ids, each), pa.int64()), "vec_id": pa.array(named.astype(np.int64)), "score": pa.array(scores, pa.float64())})

    return scan


def search(queries: DataFrame, candidates: DataFrame, k: int, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest found for each query id."""
    spark = candidates.sparkSession
    rows = valid(candidates)
    kind = rows.schema["x"].dataType.simpleString()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).toArrow()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(v) for v in sample["x"]])
    d = int(np.bincount(lengths).argmax())
    sample = _unit(_matrix(sample.filter(pa.array(lengths == d))["x"]))
    rows = rows.filter(F.size("x") == d)
    lists = min(max(1, int(np.sqrt(rows.count()))), max(1, len(sample) // SAMPLE_A_LIST))
    means = centres(sample, lists)
    probes = probes_needed(sample, means, k, recall)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = (_unit(_matrix(batch.column(1))).astype(np.float32) @ means.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0), batch.column(1)], names=["list", "vec_id", "x"])

    placed = checkpoint(rows.mapInArrow(put, f"list int, vec_id long, x {kind}"))
    sizes = np.zeros(lists, np.int64)
    for row in placed.groupBy("list").count().collect():
        sizes[row[0]] = row[1]
    first, parts = grouped(sizes, means)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                near = _unit(_matrix(some.column(1))).astype(np.float32) @ means.T
                order = np.argsort(-near, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                enough = 1 + np.argmax(held >= min(k + 1, int(sizes.sum())), axis=1)
                asked = np.minimum(np.maximum(enough, probes), lists)
                bound = np.take_along_axis(near, order[np.arange(len(some)), asked - 1][:, None], axis=1)[:, 0]
                row, lst = np.nonzero((near >= bound[:, None]) & (sizes > 0))
                each = parts[lst]
                group = np.repeat(first[lst], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                pairs = np.unique(np.stack([np.repeat(row, each), group]), axis=1)
                take = pa.array(pairs[0])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].astype(np.int32)), pa.array(np.full(len(take), -1, np.int32)), some.column(0).take(take), some.column(1).take(take), pa.array(bound[pairs[0]].astype(np.float64))], names=["group", "list", "vec_id", "x", "bound"])

    shape = f"group int, list int, vec_id long, x {kind}, bound double"
    asked = valid(queries).filter(F.size("x") == d).groupBy("vec_id").agg(F.min("x").cast(kind).alias("x")).mapInArrow(probe, shape)
    groups = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts))], "list int, first int, parts int")
    group = (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("parts"))).cast("int")
    held = placed.join(F.broadcast(groups), "list").select(group.alias("group"), "list", "vec_id", "x", F.lit(0.0).alias("bound"))
    found = asked.unionByName(held).groupBy("group").applyInArrow(scanner(means, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
