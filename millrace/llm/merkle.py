"""Operator 11: a Merkle manifest of a dataset by nested structs.

Leaves are numbered within their tree: rows are sorted by range, and the sums of the ranges
and where a tree begins give a row its rank without a task that sees a whole tree. The rank
is cut into digits. Within a block of ``fan ** digits`` leaves, the lowest digit is grouped
away first: the nodes that share all other digits become the children of one struct, whose
hash is that of theirs. What is left after all digits is one row for each block, which nests
the block's whole tree and no more. One shuffle deals the blocks, and all groupings go on in
it. Blocks are the leaves of the next tier, up to one row for each tree, and trees are in
turn the leaves of a last one. Then each tier's rows get what their tops were told from
above, by a grouping of the two, and a transform from the top to the leaves, and one
explode, give each leaf the siblings on its way. Nothing is joined to leaves but the first
rank of their tree.

Defined results: a null field counts as "-". Leaves of one doc_id ascend by their hash, null
ids come first; equal rows are leaves of their own. A null lang is a tree of its own, before
all others, an empty one too. A lone leaf is its tree's root, a lone tree's root is the
root; a leaf without siblings has the hash of an empty text as proof. A null doc_id or
n_chars is not tampered with. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, join_counted, pieces

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FAN, DIGITS = 2, 8
#: Rows of a range, of which each is sorted and numbered in one task.
RANGE_ROWS = 1 << 20
PLACE = 33  # bits of monotonically_increasing_id that count within a partition


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The hash of fields, each after its length in bytes."""
    as_text = [c.cast("string") for c in fields]
    return hashed(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (orders like lang, nulls first), doc_id, leaf, and tampered: the leaf with one
    added to n_chars, where that is done. Texts are read once, and do not move."""
    fields = {c: F.col(c) for c in FIELDS}
    more = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    return docs.select(tree.alias("tree"), "doc_id", leaf_of([*fields.values()]).alias("leaf"), F.when(chosen, leaf_of([*more.values()])).alias("tampered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (a written table) with position, from 0, in order of the columns; equal rows are
    told apart by where they stand, so that many of them are not one range."""
    ranges = pieces(rows.count(), RANGE_ROWS)
    sorted_ = rows.withColumn("stands", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "stands").sortWithinPartitions(*order, "stands")
    placed = checkpoint(sorted_.drop("stands").withColumn("place", F.monotonically_increasing_id())).withColumn("range", F.shiftright("place", PLACE))
    begins, starts = 0, []
    for number, count in placed.groupBy("range").count().orderBy("range").collect():  # as many rows as ranges
        starts.append((number, begins))
        begins += count
    known = rows.sparkSession.createDataFrame(starts, "range long, begins long")
    within = F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1))
    return placed.join(F.broadcast(known), "range").withColumn("position", F.col("begins") + within).drop("range", "place", "begins")


def _digit(level: int, fan: int) -> Column:
    return (F.floor(F.col("rank") / fan**level) % fan).cast("int")


def _blocks(nodes: DataFrame, fan: int, digits: int) -> DataFrame:
    """tree, n, block and node: of each block one row that nests its tree."""
    names = [f"d{level}" for level in range(digits)]
    rows = nodes.select("tree", "n", F.floor(F.col("rank") / fan**digits).cast("long").alias("block"), *(_digit(level, fan).alias(name) for level, name in enumerate(names)), "node")
    rows = rows.repartition("tree", "block")
    for level, name in enumerate(names):
        rows = rows.groupBy("tree", "n", "block", *names[level + 1 :]).agg(F.transform(F.array_sort(F.collect_list(F.struct(name, "node"))), lambda c: c["node"]).alias("below"))
        whole = F.array_join(F.transform("below", lambda c: c["h"]), "")
        h = F.when(F.col("n") > fan**level, F.sha2(whole, 256)).otherwise(F.col("below")[0]["h"])  # a lone node is the top
        rows = rows.select("tree", "n", "block", *names[level + 1 :], F.struct(h.alias("h"), "below").alias("node"))
    return rows


def _steps(top: Column, above: Column, fan: int, digits: int) -> Column:
    """For the leaves of a block, in order, node and steps: what stands left and right of
    each node on the way up, first that of the leaf."""
    found = F.array(F.struct(top.alias("node"), above.alias("steps")))
    for level in reversed(range(digits)):
        found = F.flatten(F.transform(found, _children(F.col("n") > fan**level, fan)))
    return found


def _children(applied: Column, fan: int) -> Callable[[Column], Column]:
    """The children of an entry, each with its step before those above, where one is taken."""

    def of(e: Column) -> Column:
        below = e["node"]["below"]
        side = lambda start, length: F.array_join(F.transform(F.slice(below, start, length), lambda c: c["h"]), "")

        def one(c: Column, i: Column) -> Column:
            step = F.struct(side(F.lit(1), i).alias("left"), side(i + 2, F.lit(fan)).alias("right"))
            return F.struct(c.alias("node"), F.when(applied, F.concat(F.array(step), e["steps"])).otherwise(e["steps"]).alias("steps"))

        return F.transform(below, one)

    return of


def paths(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame], fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """tree, rank, node, steps and up of each of ``nodes`` (tree, rank, n: nodes of the tree,
    at most ``most``, and node, a struct whose h is a hash). ``crown`` is given tree and h of
    every tree's top, and gives tree, steps and up of each."""
    size = fan**digits
    blocks = checkpoint(_blocks(nodes, fan, digits))
    if most > size:
        tops = blocks.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.struct(F.col("node.h").alias("h")).alias("node"))
        told = paths(tops, -(-most // size), crown, fan, digits).select("tree", F.col("rank").alias("block"), "steps", "up")
    else:
        told = crown(blocks.select("tree", F.col("node.h").alias("h"))).select("tree", F.lit(0).cast("long").alias("block"), "steps", "up")
    both = blocks.unionByName(told, allowMissingColumns=True).groupBy("tree", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "steps", "up")))
    out = both.select("tree", "block", "up", F.posexplode(_steps(F.col("node"), F.col("steps"), fan, digits)).alias("at", "e"))
    return out.select("tree", (F.col("block") * size + F.col("at")).alias("rank"), "e.node", "e.steps", "up")


STEPS = "array<struct<left: string, right: string>>"


def _root_of(tops: DataFrame, fan: int, digits: int) -> DataFrame:
    """tree, steps and up (subroot and root) of each tree: the tree of their tops."""
    tops = checkpoint(tops)
    n = tops.count()
    nodes = numbered(tops, "tree").select(F.lit("").alias("tree"), F.col("position").alias("rank"), F.lit(n).cast("long").alias("n"), F.struct("h", F.col("tree").alias("of")).alias("node"))
    top = lambda last: last.select("tree", F.array().cast(STEPS).alias("steps"), F.struct(F.col("h").alias("root")).alias("up"))
    found = paths(nodes, n, top, fan, digits)
    return found.select(F.col("node.of").alias("tree"), "steps", F.struct(F.col("node.h").alias("subroot"), F.col("up.root").alias("root")).alias("up"))


def manifest(docs: DataFrame, fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row: its
    place in the tree of its lang and in that of all langs, and what its siblings make of it
    after some leaves were tampered with."""
    rows = numbered(checkpoint(leaves(docs)), "tree", "doc_id", "leaf")
    trees = checkpoint(rows.groupBy("tree").agg(F.min("position").alias("first"), F.count("*").alias("n")))
    most = trees.agg(F.max("n")).first()[0] or 0
    node = F.struct(F.col("leaf").alias("h"), "doc_id", "tampered").alias("node")
    nodes = join_counted(rows, trees, ["tree"]).select("tree", (F.col("position") - F.col("first")).alias("rank"), "n", node)
    found = paths(nodes, most, lambda tops: _root_of(tops, fan, digits), fan, digits)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("steps", F.coalesce("node.tampered", "node.h"), lambda h, s: hashed(s["left"], h, s["right"]))
    out = found.select("node.doc_id", F.col("node.h").alias("leaf"), "up.subroot", "up.root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
