"""Two rankings made one by reciprocal ranks, and what was found looked up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import RetrieveError
from millrace.operators import lexical, vector

RRF_K, OVERSAMPLE = 60, 2
MOST_K = 200
Rerank = Callable[[DataFrame, str], DataFrame]


def unchanged(results: DataFrame, query: str) -> DataFrame:
    """The default second ranking: none."""
    return results


def ranked(found: DataFrame, key: str, name: str) -> DataFrame:
    """Places from 1 by score, ties to the smaller key; for a list that a top-k has made short."""
    return found.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias(name))


def fuse(by_vector: DataFrame, by_text: DataFrame, key: str, k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """key, score, vec_rank, lex_rank and rank of the union of two short lists of places.

    A row's score is the sum of 1 / (rrf_k + place) over the lists that have it; ties go to
    the better place by vector, then by text.
    """
    if rrf_k < 1:
        raise RetrieveError("rrf_k must be at least 1", {"rrf_k": rrf_k})
    both = by_vector.join(by_text, key, "full_outer")
    out = both.withColumn("score", _reciprocal(rrf_k)).withColumn("rank", F.row_number().over(Window.orderBy(*(by(c) for by, c in _FUSED))))
    return out if k is None else out.filter(F.col("rank") <= k)


_FUSED = (F.desc, "score"), (F.asc_nulls_last, "vec_rank"), (F.asc_nulls_last, "lex_rank")


def _reciprocal(rrf_k: int) -> Column:
    part = lambda c: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    return F.round(part("vec_rank") + part("lex_rank"), 9)


def hybrid_many(vectors: DataFrame, stored: tuple[DataFrame, DataFrame], key: str, asked: DataFrame, k: int = 10, where: Column | None = None, vector_column: str = "vector", rrf_k: int = RRF_K, oversample: int = OVERSAMPLE) -> DataFrame:
    """query_id, key, score, vec_rank, lex_rank and rank: for each row (query_id, words, vector)
    of ``asked`` what ``hybrid`` ranks, all questions in one plan. A question without words,
    or whose vector has no direction, is searched by the other alone."""
    if not 1 <= k <= MOST_K or oversample < 1 or rrf_k < 1:
        raise RetrieveError("k, oversample or rrf_k out of range", {"k": k, "oversample": oversample, "rrf_k": rrf_k})
    rows = vectors if where is None else vectors.filter(where)
    near = vector.cosine_topk_batch(rows, key, vector_column, asked.select("query_id", "vector"), k * oversample, own=True)
    matching = lexical.bm25_many(stored, key, asked.select("query_id", "words"), k * oversample, where)
    both = near.select("query_id", key, F.col("rank").alias("vec_rank")).join(matching.select("query_id", key, F.col("rank").alias("lex_rank")), ["query_id", key], "full_outer")
    order = Window.partitionBy("query_id").orderBy(*(by(c) for by, c in _FUSED))
    return both.withColumn("score", _reciprocal(rrf_k)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hydrated(found: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """What the rows of ``rows`` hold for the short list ``found``; keys without a row go."""
    return F.broadcast(found).join(rows, key)


def repo_of(filters: dict | None) -> str | None:
    """The repository that a request asks for; other filters are not known here and ignored."""
    repo = (filters or {}).get("repo_id")
    if repo is not None and not isinstance(repo, str):
        raise RetrieveError("repo_id must be a string", {"repo_id": repo})
    return repo


def hybrid(
    rows: DataFrame,
    vectors: DataFrame,
    key: str,
    columns: tuple[str, ...],
    query: str,
    query_vector: list[float],
    k: int = 10,
    filters: dict | None = None,
    vector_column: str = "vector",
    rrf_k: int = RRF_K,
    oversample: int = OVERSAMPLE,
    rerank: Rerank = unchanged,
    stored: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The k best rows by vector and by text, with score, rank and source, best first.

    Both searches rank keys alone; contents are read for the k keys that are left. A query
    without a term is searched by vector only. Texts are searched by their ``stored`` postings
    and lengths, or read through where there are none.
    """
    if not query or not 1 <= k <= MOST_K:
        raise RetrieveError("a request needs a text and a k in range", {"k": k, "most": MOST_K})
    if oversample < 1:
        raise RetrieveError("oversample must be at least 1", {"oversample": oversample})
    repo = repo_of(filters)
    of_repo = None if repo is None else F.col("repo_id") == repo
    near = ranked(vector.cosine_topk(vectors, key, vector_column, query_vector, k * oversample, of_repo), key, "vec_rank")
    words = lexical.query_terms(rows.sparkSession, query)
    if words:
        found = lexical.bm25_scan(rows, key, columns, words, k * oversample, of_repo) if stored is None else lexical.bm25(stored, key, words, k * oversample, of_repo)
        matching = ranked(found, key, "lex_rank")
    else:
        matching = rows.limit(0).select(key, F.lit(0).alias("lex_rank"))
    best = fuse(near, matching, key, k, rrf_k)
    found = hydrated(best, rows, key).withColumn("source", F.lit("fused"))
    return rerank(found.orderBy("rank"), query)
