"""Lookups of chunks and citations of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import AskError

SNIPPET = 800


def get(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def get_many(rows: DataFrame, key: str, ids: DataFrame, place: str = "place") -> DataFrame:
    """Rows for a list of ids (columns ``key`` and ``place``), in the list's order: unknown
    ids are skipped, an id that is listed twice comes twice."""
    return ids.join(rows, key).orderBy(place)


def by_path(chunks: DataFrame, repo_id: str, path: str) -> DataFrame:
    return chunks.filter((F.col("repo_id") == repo_id) & (F.col("path") == path)).orderBy("start_line")


def overlapping(chunks: DataFrame, start_line: int, end_line: int) -> DataFrame:
    """Chunks that share a line with the range."""
    if start_line < 1 or end_line < start_line:
        raise AskError("not a line range", {"start_line": start_line, "end_line": end_line})
    return chunks.filter((F.col("start_line") <= end_line) & (F.col("end_line") >= start_line))


def citation(most: int = SNIPPET, content: str = "content") -> Column:
    """A chunk as a citation: the snippet is the plain beginning of its content."""
    if most < 0:
        raise AskError("a snippet has no negative length", {"most": most})
    return F.struct("path", "start_line", "end_line", "symbol", F.substring(content, 1, most).alias("snippet"))


def citations(found: DataFrame, rank: str = "rank", most: int = SNIPPET, by: tuple[str, ...] = ()) -> DataFrame:
    """Citations of ranked chunks; of equal path and lines (of one value of ``by``) the first stays."""
    lines = [f"citation.{c}" for c in ("path", "start_line", "end_line")]
    first = F.row_number().over(Window.partitionBy(*by, *lines).orderBy(rank))
    kept = found.select(*by, rank, citation(most).alias("citation")).withColumn("n_", first).filter("n_ = 1")
    return kept.drop("n_").orderBy(*by, rank, *lines)  # by lines too, as many may have one rank, and these would be one task's


def blocks(found: DataFrame, rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each value of ``by``): the ranked chunks as texts, best first."""
    header = F.concat_ws(" ", F.concat("path", F.lit(", lines "), "start_line", F.lit("-"), "end_line"), F.concat(F.lit("in "), "symbol"))
    block = F.struct(rank, F.concat_ws("\n", header, "content").alias("block"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]).alias("blocks"))


def context(found: DataFrame, rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """The ranked chunks as one text for a prompt, as ``blocks`` gives them."""
    joined = F.when(F.size("blocks") == 0, "Nothing in the index matches the question.").otherwise(F.array_join("blocks", "\n\n"))
    return blocks(found, rank, by).select(*by, joined.alias("context"))
