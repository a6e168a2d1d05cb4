"""Text as columns: words for search, lines, paths, hashes, rates of agreement."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A query or document term: letters and digits of any script.
TERM = r"[\p{L}\p{N}]+"
#: What ends a line besides a line feed.
OTHER_BREAKS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]"


@functools.lru_cache(maxsize=1)
def _unaccented() -> tuple[str, str]:
    """Lower-case Latin, Greek and Cyrillic letters that are one letter and marks, and that letter."""
    marked, plain = [], []
    for point in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        letter = chr(point)
        parts = unicodedata.normalize("NFD", letter)
        if letter.isalpha() and letter == letter.lower() and len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            marked.append(letter)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def folded(text: Column) -> Column:
    """Lower case, without marks on letters."""
    return F.translate(F.lower(text), *_unaccented())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0))


def lines(text: Column) -> Column:
    """Lines of a text; a line break at its end does not begin another."""
    even = F.regexp_replace(text, OTHER_BREAKS, "\n")
    cut = F.split(even, "\n", -1)
    return F.when(F.length(even) == 0, F.array().cast("array<string>")).when(even.endswith("\n"), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\s\x1c-\x1f\x85   -     　]")


def suffix(path: Column) -> Column:
    """The last suffix of a path's name with its dot, in lower case; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """A path's name without its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(repo_id: Column, path: Column, start: Column, end: Column, hashed: Column) -> Column:
    """32 hex digits that name a chunk by where and what it is."""
    where = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return F.substring(F.sha2(F.concat_ws("\n", repo_id, path, where, hashed), 256), 1, 32)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length, or a component is null."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
