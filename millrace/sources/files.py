"""Folders of source files as a DataFrame.

The driver lists folders, as ignore rules decide which are entered; the list of paths is
dealt to tasks, which read the files. A folder must be mounted on all executors, or be on
a file system that Spark reads (then use ``read_listed`` on paths of your own).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import ScanError
from millrace.functions import text as t
from millrace.operators import chunking
from millrace.sources import language

SNIFFED = 8192

# fixed values: patterns that are always ignored
ALWAYS_IGNORED = [
    ".git/",
    "node_modules/",
    ".venv/",
    "venv/",
    "__pycache__/",
    "dist/",
    "build/",
    "*.lock",
    "*.pyc",
    "*.pyo",
    "*.so",
    "*.dylib",
    "*.dll",
]


def _glob(pattern: str) -> str:
    """A regular expression for a pattern of path parts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.*")
            i += 3
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def _rule(line: str) -> tuple[bool, str] | None:
    """Whether a line of an ignore file ignores or takes back, and a regular expression for
    the paths that it means; none for a comment."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    ignored = not line.startswith("!")
    pattern = line if ignored else line[1:]
    folder = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    rooted = "/" in pattern
    return ignored, ("" if rooted else "(?:.*/)?") + _glob(pattern.lstrip("/")) + ("/.*" if folder else "(?:/.*)?")


class IgnoreRules:
    """Lines of ignore files; the last that matches a path decides, and ``!`` takes it back."""

    def __init__(self, lines: list[str]):
        self.rules = [(rule[0], re.compile(rule[1] + r"\Z", re.DOTALL)) for rule in map(_rule, lines) if rule]

    def ignores(self, path: str) -> bool:
        """``path`` is relative to the root; a folder's ends with a slash."""
        return next((ignored for ignored, rule in reversed(self.rules) if rule.match(path)), False)


def unignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths (repo_id, path, from the root of the repository) that no rule ignores.

    ``rules`` (repo_id, folder, number, line) holds the lines of all ignore files: folder is ""
    for the root, else ends with a slash. Every folder on the way to a path, and the path, meets
    the rules of the folders above it; of those that match, the deepest folder's last one
    decides, and what lies in an ignored folder goes with it. Folders are judged once each,
    however many files they hold, and no path is seen by the driver."""

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(row.repo_id, row.folder, row.number, *rule) for row in batch.itertuples() if (rule := _rule(row.line))]
            yield pd.DataFrame(found, columns=["repo_id", "folder", "number", "ignored", "pattern"])

    known = rules.select("repo_id", "folder", "number", "line").mapInPandas(compiled, "repo_id string, folder string, number long, ignored boolean, pattern string")
    parts = F.split("path", "/", -1)
    folder = lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n < F.size(parts), folder(n)).otherwise(F.col("path")))
    ways = paths.select("repo_id", "path", F.explode(steps).alias("step"))
    above = F.transform(F.sequence(F.lit(0), F.size(F.split(F.rtrim("path", F.lit("/")), "/", -1)) - 1), folder)
    met = ways.select("repo_id", F.col("step").alias("path")).distinct().select("repo_id", "path", F.explode(above).alias("folder")).join(known, ["repo_id", "folder"])
    holds = met.filter(F.regexp("path", F.concat(F.lit("(?s)^"), "pattern", F.lit("$"))))
    depth = F.size(F.split("folder", "/", -1))
    last = holds.groupBy("repo_id", F.col("path").alias("step")).agg(F.max_by("ignored", F.struct(depth, "number")).alias("ignored"))
    gone = ways.join(last.filter("ignored"), ["repo_id", "step"], "left_semi").select("repo_id", "path").distinct()
    return paths.join(gone, ["repo_id", "path"], "left_anti")


def _lines(path: Path) -> list[str]:
    return path.read_text(encoding="utf-8", errors="replace").splitlines() if path.is_file() else []


def listed(root: str, extra_ignores: list[str] | None = None) -> Iterator[tuple[str, str]]:
    """Absolute and relative paths of files that no rule ignores; links are not followed.

    Rules of a folder's own file hold below it, and are matched against paths from the root.
    """
    top = Path(root).resolve()
    if not top.is_dir():
        raise ScanError("not a folder", {"root": root})
    exclude = [line for line in _lines(top / ".git/info/exclude") if line.strip() and not line.strip().startswith("#")]
    waiting = [(top, [*ALWAYS_IGNORED, *(extra_ignores or []), *exclude])]
    while waiting:
        folder, lines = waiting.pop()
        lines = lines + _lines(folder / ".gitignore")
        rules = IgnoreRules(lines)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for entry in entries:
            relative = Path(entry.path).relative_to(top).as_posix()
            inside = entry.is_dir(follow_symlinks=False)
            if rules.ignores(relative + "/" * inside):
                continue
            if inside:
                waiting.append((Path(entry.path), lines))
            elif entry.is_file(follow_symlinks=False):
                yield entry.path, relative


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples():
            try:
                stat = os.stat(row.file)
                with open(row.file, "rb") as handle:
                    raw = handle.read()
                rows.append((row.repo_id, row.path, stat.st_mtime, stat.st_size, b"\0" in raw[:SNIFFED], raw.decode("utf-8", "replace")))
            except OSError:
                rows.append((row.repo_id, row.path, None, None, None, None))
        yield pd.DataFrame(rows, columns=["repo_id", "path", "mtime", "size", "binary", "content"])


def scan(spark: SparkSession, root: str, repo_id: str, extra_ignores: list[str] | None = None) -> DataFrame:
    """repo_id, path, mtime, size, language and content of a folder's text files; those that
    can't be read have a null content and stay, so that they can be counted."""
    if not repo_id or not repo_id.strip():
        raise ScanError("repo_id is needed")
    paths = [(repo_id, path, relative) for path, relative in listed(root, extra_ignores)]
    rows = spark.createDataFrame(paths, "repo_id string, file string, path string")
    read = rows.repartition(max(1, len(paths) // 200)).mapInPandas(_read, "repo_id string, path string, mtime double, size bigint, binary boolean, content string")
    text = read.filter(~F.coalesce("binary", F.lit(False))).drop("binary")
    return text.withColumn("language", language.detected(F.col("path"), F.coalesce("content", F.lit("")))).select("repo_id", "path", "mtime", "size", "language", "content")


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path, mtime and size are not as before."""
    return files.join(known.select("repo_id", "path", "mtime", "size"), ["repo_id", "path", "mtime", "size"], "left_anti")


def ingest(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of the files to take, and one row of counts."""
    fresh = files if known is None else changed(files, known)
    taken = fresh.filter(F.col("language").isNotNull() & F.col("content").isNotNull() & ~t.is_blank(F.coalesce("content", F.lit(""))))
    chunks = chunking.chunk_files(taken)
    counts = fresh.agg(
        F.count_if(F.col("content").isNotNull() & F.col("language").isNull()).alias("files_skipped_no_language"),
        F.count_if(F.col("content").isNull()).alias("files_skipped_unreadable"),
        F.count("*").alias("fresh"),
    )
    made = chunks.agg(F.count_distinct("repo_id", "path").alias("files_chunked"), F.count("*").alias("chunks_emitted"))
    seen = files.agg(F.count("*").alias("files_seen"))
    stats = seen.crossJoin(counts).crossJoin(made)  # one row each
    return chunks, stats.withColumn("files_skipped_unchanged", F.col("files_seen") - F.col("fresh")).drop("fresh")
