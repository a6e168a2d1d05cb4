"""Match texts: terms, "phrases", pre*, field:term, NEAR(a b, n), AND, OR, NOT and brackets.

Texts are asked of stored postings (term, key, field, dl, tf and positions), never of the rows
that they come from. A match text becomes a condition on its leaves, the phrases that it
holds. One grouping by key brings the positions of all asked terms of a row together; there,
phrases and neighbours are found by array functions, and the condition says which rows stay.

Terms that follow each other must all hold, and bind more tightly than NOT, AND and OR, in
this order. A word of several terms, like a quoted text, is a phrase. ``^`` asks for the start
of a field, ``{a b}: x`` for one of several fields, ``- a: x`` for all but one. Phrases without
a term are left out; a text that has no other, or that can't be read, is a ``StoreError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import RetrieveError, StoreError
from millrace.functions import text as t
from millrace.operators import lexical

PIECE = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\x80-\U0010ffff]+)|(?P<mark>[(){}:+*^,-]))')
WORDS = ("AND", "OR", "NOT")
NEAR_TOKENS = 10


@dataclass(frozen=True)
class Leaf:
    """A phrase: its texts, later its terms; whether the last is a prefix, whether it starts a
    field; which fields count (None: all), and the NEAR group that it belongs to."""

    texts: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    fields: frozenset[str] | None = None
    group: int | None = None
    within: int = NEAR_TOKENS


@dataclass(frozen=True)
class Both:
    """Two parts under AND, OR or NOT."""

    word: str
    left: Leaf | Both
    right: Leaf | Both


class _Reader:
    """Reads a match text from left to right, one method for each level of binding."""

    def __init__(self, text: str, fields: frozenset[str]):
        self.text, self.fields, self.groups = text, fields, 0
        self.pieces: list[tuple[str, str]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            found = PIECE.match(text, at)
            if not found:
                raise self.wrong("a match text has a mark that it can't hold", text[at:].strip()[:1])
            self.pieces.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def wrong(self, message: str, near: str) -> StoreError:
        return StoreError(message, {"query": self.text, "near": near})

    def next(self, ahead: int = 0) -> tuple[str, str]:
        return self.pieces[self.at + ahead] if self.at + ahead < len(self.pieces) else ("end", "")

    def take(self, *marks: str) -> bool:
        """Goes on if one of these marks or words comes next."""
        kind, value = self.next()
        if kind in ("mark", "word") and value in marks:
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise self.wrong(f"a match text needs {mark} here", self.next()[1])

    def whole(self) -> Leaf | Both:
        found = self.level(0, None)
        if self.next()[0] != "end":
            raise self.wrong("a match text goes on after its end", self.next()[1])
        return found

    def level(self, number: int, only: frozenset[str] | None) -> Leaf | Both:
        word = ("OR", "AND", "NOT")[number]
        read = (lambda: self.level(number + 1, only)) if number < 2 else (lambda: self.listed(only))
        found = read()
        while self.next() == ("word", word):
            self.at += 1
            found = Both(word, found, read())
        return found

    def listed(self, only: frozenset[str] | None) -> Leaf | Both:
        """Brackets, or what stands side by side."""
        named = self.named(only)
        if self.take("("):
            found = self.level(0, named)
            self.need(")")
            return found
        found = self.one(named)
        while self.next()[0] != "end" and self.next() != ("mark", ")") and self.next()[1] not in WORDS:
            found = Both("AND", found, self.one(self.named(only)))
        return found

    def named(self, only: frozenset[str] | None) -> frozenset[str] | None:
        """The fields that are named here, out of those that count already."""
        start = self.at
        but = self.take("-")
        names = []
        if self.take("{"):
            while not self.take("}"):
                names.append(self.string())
        elif self.next(1) == ("mark", ":"):
            names.append(self.string())
        if not names or not self.take(":"):
            if but or names or self.at > start:
                raise self.wrong("a match text names no field here", self.next()[1])
            return only
        if set(names) - self.fields:
            raise self.wrong("a match text names a field that is not there", ", ".join(sorted(set(names) - self.fields)))
        named = self.fields - set(names) if but else frozenset(names)
        return named if only is None else named & only

    def one(self, fields: frozenset[str] | None) -> Leaf | Both:
        if self.next() == ("word", "NEAR") and self.next(1) == ("mark", "("):
            self.at += 2
            self.groups += 1
            group, leaves, within = self.groups, [], NEAR_TOKENS
            while not self.take(")"):
                if self.take(","):
                    kind, value = self.next()
                    if kind != "word" or not value.isdecimal() or self.next(1) != ("mark", ")"):
                        raise self.wrong("NEAR needs a number here", value)
                    within = int(value)
                    self.at += 1
                else:
                    leaves.append(self.phrase(fields))
            if not leaves:
                raise self.wrong("NEAR needs a phrase", "NEAR")
            leaves = [replace(leaf, group=group, within=within) for leaf in leaves] if len(leaves) > 1 else leaves
            return reduce(lambda a, b: Both("AND", a, b), leaves)
        return self.phrase(fields)

    def phrase(self, fields: frozenset[str] | None) -> Leaf:
        first = self.take("^")
        texts = [self.string()]
        while self.take("+"):
            texts.append(self.string())
        return Leaf(tuple(texts), self.take("*"), first, fields)

    def string(self) -> str:
        kind, value = self.next()
        if kind not in ("word", "quoted") or kind == "word" and value in WORDS:
            raise self.wrong("a match text needs a term here", value)
        self.at += 1
        return value[1:-1].replace('""', '"') if kind == "quoted" else value


def _leaves(node: Leaf | Both) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    else:
        yield from _leaves(node.left)
        yield from _leaves(node.right)


def parse(spark: SparkSession, text: str, fields: tuple[str, ...]) -> Leaf | Both:
    """A match text as a tree whose leaves hold terms, folded as those of the index."""
    tree = _Reader(text, frozenset(fields)).whole() if text.strip() else None
    strings = sorted({s for leaf in _leaves(tree) for s in leaf.texts}) if tree else []
    terms = spark.range(1).select(F.array(*(t.terms(F.lit(s)) for s in strings)).alias("x")).first()[0] if strings else []
    known = dict(zip(strings, terms))

    def filled(node: Leaf | Both) -> Leaf | Both | None:
        if isinstance(node, Leaf):
            found = tuple(term for s in node.texts for term in known[s])
            return replace(node, texts=found) if found else None
        left, right = filled(node.left), filled(node.right)
        if left and right:
            return Both(node.word, left, right)
        return left if left or node.word == "NOT" else right

    tree = filled(tree) if tree else None
    if tree is None:
        raise StoreError("a query needs a term", {"query": text})
    return tree


def _holds(node: Leaf | Both, of: Callable[[Leaf], Column]) -> Column:
    if isinstance(node, Leaf):
        return of(node)
    left, right = _holds(node.left, of), _holds(node.right, of)
    return left | right if node.word == "OR" else left & ~right if node.word == "NOT" else left & right


def _is(slot: tuple[str, bool]) -> Column:
    return F.col("term").startswith(slot[0]) if slot[1] else F.col("term") == slot[0]


def _slots(leaf: Leaf) -> list[tuple[str, bool]]:
    return [(term, leaf.prefix and i == len(leaf.texts) - 1) for i, term in enumerate(leaf.texts)]


def asked(leaves: list[Leaf]) -> Column:
    """The terms that leaves ask for, as a condition that prunes files which hold ranges of terms."""
    return reduce(lambda a, b: a | b, map(_is, sorted({s for leaf in leaves for s in _slots(leaf)})))


def _plus(places: Column | str, n: int) -> Column:
    return F.transform(places, lambda p: p + n)


def _starts(leaf: Leaf, positions: dict[tuple[str, bool], Column]) -> Column:
    """Where in a field the phrase begins."""
    found = reduce(F.array_intersect, (_plus(positions[slot], -i) for i, slot in enumerate(_slots(leaf))))
    if leaf.first:
        found = F.filter(found, lambda p: p == 0)
    return found if leaf.fields is None else F.when(F.col("field").isin(*sorted(leaf.fields)), found).otherwise(F.array().cast("array<int>"))


def _near(group: list[tuple[Leaf, str]]) -> list[Column]:
    """Of the phrases of a NEAR group the begins that lie in a clump with all others: at most
    so many tokens lie between the end of its first phrase and the begin of its last one."""
    ends = F.concat(*(_plus(begins, len(leaf.texts)) for leaf, begins in group))
    fits = lambda leaf, begin, end: (begin + len(leaf.texts) >= end) & (begin <= end + leaf.within)

    def has_one(leaf: Leaf, begins: str, end: Column) -> Column:
        return F.exists(begins, lambda begin: fits(leaf, begin, end))

    def within(leaf: Leaf, begins: str) -> Column:
        return F.filter(begins, lambda begin: F.exists(clumps, lambda end: fits(leaf, begin, end)))

    clumps = F.filter(ends, lambda end: reduce(lambda a, b: a & b, (has_one(leaf, begins, end) for leaf, begins in group)))
    return [within(leaf, begins) for leaf, begins in group]


def search(stored: tuple[DataFrame, DataFrame], key: str, tree: Leaf | Both, k: int | None = 10, where: Column | None = None, keep: tuple[str, ...] = (), places: int = 6) -> DataFrame:
    """key and score of the k best rows (all, if None) that a parsed match text holds for.

    ``stored`` are postings with positions, and lengths. A phrase counts like a term: rows
    that have it (in the fields that it asks for) make its weight, and how often a row has it,
    in NEAR only the times that count, its part of the score. Statistics are those of the whole
    table, ``where`` on the ``keep`` columns comes after them."""
    if k is not None and k < 1:
        raise RetrieveError("k must be at least 1", {"k": k})
    leaves = list(dict.fromkeys(_leaves(tree)))
    slots = sorted({slot for leaf in leaves for slot in _slots(leaf)})
    placed = {slot: F.col(f"at{i}") for i, slot in enumerate(slots)}
    rows = stored[0].filter(asked(leaves)).repartition(key)  # no partial sums: a row's terms are few, and it is grouped twice
    each = rows.groupBy(key, "field", "dl", *keep).agg(*(F.flatten(F.collect_list(F.when(_is(slot), F.col("positions")))).alias(f"at{i}") for i, slot in enumerate(slots)))
    each = each.select(key, "dl", *keep, *(_starts(leaf, placed).alias(f"from{i}") for i, leaf in enumerate(leaves)))
    counted = {}
    for i, leaf in enumerate(leaves):
        counted[i] = F.col(f"from{i}")
    for group in {leaf.group for leaf in leaves} - {None}:
        own = [i for i, leaf in enumerate(leaves) if leaf.group == group]
        counted |= dict(zip(own, _near([(leaves[i], f"from{i}") for i in own])))
    each = each.select(key, "dl", *keep, *(F.size(f"from{i}").alias(f"any{i}") for i in counted), *(F.size(c).alias(f"tf{i}") for i, c in counted.items()))
    found = each.groupBy(key, "dl", *keep).agg(*(F.sum(f"{name}{i}").alias(f"{name}{i}") for i in counted for name in ("any", "tf")))
    weights = found.agg(*(F.count_if(F.col(f"any{i}") > 0).alias(f"n{i}") for i in counted))
    totals = stored[1].agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    number = {leaf: i for i, leaf in enumerate(leaves)}
    hits = found.filter(_holds(tree, lambda leaf: F.col(f"tf{number[leaf]}") > 0))
    hits = hits if where is None else hits.filter(where)
    scored = hits.crossJoin(F.broadcast(weights)).crossJoin(F.broadcast(totals))  # one row each
    part = lambda i: F.when(F.col(f"tf{i}") > 0, lexical.part(F.col(f"n{i}"), F.col(f"tf{i}"))).otherwise(0.0)
    ranked = scored.select(key, F.round(reduce(lambda a, b: a + b, map(part, counted)), places).alias("score")).orderBy(F.desc("score"), key)
    return ranked if k is None else ranked.limit(k)


class Lexicon:
    """Postings with positions, lengths and a dictionary of terms at a path. Files of postings
    hold ranges of terms, and the dictionary, itself in order, says which files a term is in:
    a search opens these and no others."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: tuple[str, ...], keep: tuple[str, ...] = ()):
        self.spark, self.path, self.key, self.fields, self.keep = spark, path.rstrip("/"), key, fields, keep

    def write(self, rows: DataFrame, ranges: int | None = None, **columns: str) -> Lexicon:
        """Indexes rows; ``columns`` names the column of each field. Spark chooses the number of
        ranges, and so of files, where none is given."""
        lexical.by_row(rows, self.key, lexical.field_terms(columns), self.keep).write.parquet(f"{self.path}/rows")  # texts are cut into terms once
        each = self.spark.read.parquet(f"{self.path}/rows")
        repeated = lexical.repeats(each, self.key)
        found = lexical.placed_of(each, self.key, self.keep, repeated)
        found.repartitionByRange(*filter(None, [ranges]), "term", self.key).sortWithinPartitions("term", self.key).write.parquet(f"{self.path}/postings")
        each.select(self.key, *self.keep, "dl").write.parquet(f"{self.path}/lengths")
        stored = self.spark.read.parquet(f"{self.path}/postings").withColumn("file", F.col("_metadata.file_name"))
        if repeated:
            per_row = stored.groupBy("term", self.key).agg(F.sum("tf").alias("tf"), F.collect_set("file").alias("files"))
            terms = per_row.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.array_distinct(F.flatten(F.collect_set("files"))).alias("files"))
        else:  # as a row has one first posting of a term, a file's are summed where it is read
            per_file = stored.groupBy("term", "file").agg(F.count_if("first").alias("df"), F.sum("tf").alias("cf"))
            terms = per_file.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.collect_list("file").alias("files"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/terms")
        return self

    def terms(self) -> DataFrame:
        """term, df (rows that have it), cf (times it occurs) and files."""
        return self.spark.read.parquet(f"{self.path}/terms")

    def with_prefix(self, prefix: str) -> DataFrame:
        return self.terms().filter(F.col("term").startswith(prefix))

    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lengths")

    def files(self, leaves: list[Leaf]) -> list[str]:
        """The files that hold the terms asked for; never more than the index has."""
        return sorted(row[0] for row in self.terms().filter(asked(leaves)).select(F.explode("files")).distinct().collect())

    def postings(self, leaves: list[Leaf] | None = None) -> DataFrame:
        every = self.spark.read.parquet(f"{self.path}/postings")
        if leaves is None:
            return every
        files = self.files(leaves)
        return self.spark.read.schema(every.schema).parquet(*(f"{self.path}/postings/{name}" for name in files)) if files else every.limit(0)

    def search(self, text: str, k: int | None = 10, where: Column | None = None) -> DataFrame:
        tree = parse(self.spark, text, self.fields)
        return search((self.postings(list(_leaves(tree))), self.lengths()), self.key, tree, k, where, self.keep)
