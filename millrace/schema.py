"""Schemas of the tables, and the checks that their rows must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL_KINDS = ("function", "method", "class", "module", "variable", "constant", "other")
CHUNK_KINDS = ("file", "class", "function", "method", "block")
EDGE_KINDS = ("defines", "contained_in", "calls", "imports")

FILES = "repo_id string, path string, mtime double, size bigint, language string, content string"
CHUNKS = (
    "chunk_id string, repo_id string, path string, language string, kind string, symbol string, "
    "start_line int, end_line int, content string, content_hash string"
)
SYMBOLS = "path string, name string, kind string, line int, parent string, seq bigint"
EDGES = "src_path string, src_name string, dst_path string, dst_name string, kind string"
CITATION = "struct<path:string,start_line:int,end_line:int,symbol:string,snippet:string>"
USAGE = "struct<prompt:int,completion:int,total:int>"
ANSWERS = f"case_id string, text string, citations array<{CITATION}>, trace array<string>, latency_ms bigint, token_usage {USAGE}"
CASES = "case_id string, repo_id string, question string, expected_files array<string>, expected_symbols array<string>, expected_answer_traits array<string>"
RATES = "provider string, model string, prompt_per_1k double, completion_per_1k double"


def checked_chunks(chunks: DataFrame) -> DataFrame:
    """Fails, when rows are read, on a chunk that breaks a rule."""
    holds = (
        (F.length("chunk_id") > 0)
        & (F.length("repo_id") > 0)
        & (F.length("path") > 0)
        & F.col("kind").isin(*CHUNK_KINDS)
        & (F.col("start_line") >= 1)
        & (F.col("end_line") >= F.col("start_line"))
        & (F.length("content") > 0)
        & (F.length("content_hash") >= 8)
    )
    fault = F.raise_error(F.concat(F.lit("not a valid chunk: "), F.coalesce("chunk_id", F.lit("null"))))
    return chunks.withColumn("chunk_id", F.when(F.coalesce(holds, F.lit(False)), F.col("chunk_id")).otherwise(fault))
