"""The language of a file, by its suffix or else by its first line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as t

# fixed values: suffixes and interpreters with their languages
SUFFIXES = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
    ".go": "go",
    ".java": "java",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".c++": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".hxx": "cpp",
    ".h++": "cpp",
}
INTERPRETERS = {
    "python": "python",
    "python2": "python",
    "python3": "python",
    "node": "javascript",
    "ts-node": "typescript",
    "deno": "typescript",
    "bun": "typescript",
    "go": "go",
    "java": "java",
    "rustc": "rust",
}


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def by_suffix(path: Column) -> Column:
    return _mapped(SUFFIXES, t.suffix(path))


def by_interpreter(content: Column) -> Column:
    """From ``#!`` on the first line that is not blank; after ``env`` comes the program, and
    a version at its end does not matter."""
    line = F.trim(F.regexp_extract(content, r"^\s*([^\r\n]*)", 1))
    words = F.split(F.trim(F.regexp_extract(line, r"^#!(.*)$", 1)), r"\s+")
    name = lambda w: F.element_at(F.split(w, "/"), -1)
    first = name(F.get(words, 0))
    program = F.when(first == "env", name(F.get(words, 1))).otherwise(first)
    return F.coalesce(_mapped(INTERPRETERS, program), _mapped(INTERPRETERS, F.regexp_replace(program, r"[0-9.]+$", "")))


def detected(path: Column, content: Column) -> Column:
    """A language, or null."""
    return F.coalesce(by_suffix(path), by_interpreter(content))
