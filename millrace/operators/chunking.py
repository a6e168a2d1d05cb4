"""Files to chunks: fixed windows of lines in SQL, definitions of Python files by its parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.schema import CHUNKS

WINDOW, OVERLAP = 50, 5
_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


def _named(cut: DataFrame) -> DataFrame:
    """Adds hash and id to rows that have everything else of a chunk."""
    hashed = cut.withColumn("content_hash", t.content_hash(F.col("content")))
    own = t.chunk_id(F.col("repo_id"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content_hash"))
    return hashed.withColumn("chunk_id", own).select(*_NAMES)


def fixed_windows(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Blocks of ``window`` lines that share ``overlap`` lines with the next; none begins
    once a block has reached the last line. Blank files have no block."""
    step = window - overlap
    rows = files.filter(~t.is_blank(F.col("content"))).withColumn("lines", t.lines(F.col("content"))).withColumn("n", F.size("lines"))
    starts = F.filter(F.sequence(F.lit(1), F.col("n"), F.lit(step)), lambda s: (s == 1) | (s + (overlap - 1) < F.col("n")))
    cut = rows.withColumn("start_line", F.explode(starts)).withColumn("end_line", F.least(F.col("start_line") + (window - 1), "n"))
    content = F.concat(F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"), F.lit("\n"))
    return _named(cut.select("repo_id", "path", "language", F.lit("block").alias("kind"), F.lit(None).cast("string").alias("symbol"), "start_line", "end_line", content.alias("content")))


def python_definitions(source: str) -> list[tuple[str, str, int, int]]:
    """kind, name, first and last line of a module's top functions and classes, and of the
    plain methods of those classes; decorators belong to the definition, and a decorated
    method is part of its class only. Empty where the source does not parse."""
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    function = (ast.FunctionDef, ast.AsyncFunctionDef)
    found = []
    for node in body:
        if not isinstance(node, (*function, ast.ClassDef)):
            continue
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        found.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, first, node.end_lineno))
        if isinstance(node, ast.ClassDef):
            found += [("method", inner.name, inner.lineno, inner.end_lineno) for inner in node.body if isinstance(inner, function) and not inner.decorator_list]
    return found


#: Beyond any file's last line.
ITS_END = 2**31 - 1


def _definitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            found = python_definitions(r.even)
            rows += [(r.repo_id, r.path, r.language, *definition, r.even) for definition in found] or [(r.repo_id, r.path, r.language, "file", None, 1, ITS_END, r.content)]
        yield pd.DataFrame(rows, columns=["repo_id", "path", "language", "kind", "symbol", "start_line", "end_line", "content"])


def python_chunks(files: DataFrame) -> DataFrame:
    """Definitions of Python files; a file without one, or that does not parse, is one chunk.
    A file is parsed once."""
    files = files.filter(~t.is_blank(F.col("content"))).select("repo_id", "path", "language", "content")
    even = files.withColumn("even", F.array_join(t.lines(F.col("content")), "\n"))
    raw = even.mapInPandas(_definitions, "repo_id string, path string, language string, kind string, symbol string, start_line int, end_line int, content string")
    rows = t.lines(F.col("content"))
    n = F.size(rows)
    first, last = F.least(F.greatest("start_line", F.lit(1)), F.greatest(n, F.lit(1))), F.least("end_line", n)
    part = F.concat(F.array_join(F.slice(rows, first, F.greatest(last - first + 1, F.lit(0))), "\n"), F.lit("\n"))
    content = F.when(F.col("kind") == "file", F.col("content")).otherwise(part)
    return _named(raw.select("repo_id", "path", "language", "kind", "symbol", first.alias("start_line"), F.greatest(first, last).alias("end_line"), content.alias("content")))


def chunk_files(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Python files by definition, all others by window."""
    python = F.col("language") == "python"
    return python_chunks(files.filter(python)).unionByName(fixed_windows(files.filter(~python | F.col("language").isNull()), window, overlap))
