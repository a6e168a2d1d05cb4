"""Operator 5: best-fit packing into sequences of several permitted lengths.

Texts are measured in words. A text longer than the largest length is cut into pieces of
that length and a rest, so every word is packed exactly once. Pieces are dealt to shards
by a hash of their id and number, about ``SHARD_PIECES`` to each; a shard packs its pieces
from the longest to the shortest. A piece goes into the open bin, of whatever length, that
it leaves the least room in. If none fits, a bin is opened of the length that costs least
for each word it is going to hold: the cost is the length plus ``overhead``, the words are
the piece's and those of the pieces still to come that fill the rest, from the longest that
fits on. In the end each bin is cut down to the shortest length that holds its contents,
which is its capacity. Where the largest length alone would have cost a shard less, the
shard is packed so.

Defined results: null and wordless texts are one piece of no words with no bin (null
bin_id and capacity); equal pieces go by doc_id, piece, then text; repeated rows are packed
as often as they occur; different texts of one id are told apart by a hash; rows with a
null doc_id come last; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named, tagged, words_of

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 32
SHARD_PIECES = 20_000
PLACED = "doc_id long, tag long, piece long, start long, words long, bin_id string, capacity int, position int"


def _filled(room: int, sizes: list[int], begin: int) -> int:
    """Words that pieces from ``begin`` on put into so much room, each time the longest that
    fits; ``sizes`` are negative and do not fall."""
    words = 0
    while room and (begin := bisect_left(sizes, -room, begin)) < len(sizes):
        size = -sizes[begin]
        some = min(bisect_right(sizes, -size, begin) - begin, room // size)
        words, room, begin = words + some * size, room - some * size, begin + some
    return words


def _packed(sizes: list[int], lengths: list[int], overhead: float) -> tuple[list[int], list[int], list[int]]:
    """``room`` lists the remaining rooms that some bin has, in order; ``bins`` the bins of each."""
    falling = [-s for s in sizes]
    room: list[int] = []
    bins: dict[int, list[int]] = {}
    used: list[int] = []
    of, position = [], []
    for at, size in enumerate(sizes):
        i = bisect_left(room, size)
        if i < len(room):
            left = room[i]
            number = bins[left].pop()
            if not bins[left]:
                del bins[left], room[i]
        else:
            each = lambda c: ((c + overhead) / (size + _filled(c - size, falling, at + 1)), -c)  # noqa: B023, E731
            number, left = len(used), min(lengths[bisect_left(lengths, size) :], key=each)
            used.append(0)
        of.append(number)
        position.append(used[number])
        used[number] += size
        left -= size
        if left:
            if left not in bins:
                bins[left] = []
                room.insert(bisect_left(room, left), left)
            bins[left].append(number)
    return of, position, used


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and place in the bin of each size (above 0, and not growing), and each bin's capacity."""
    lengths = sorted(capacities)
    found = []
    for allowed in (lengths, lengths[-1:]):
        of, position, used = _packed(sizes, allowed, overhead)
        capacity = [lengths[bisect_left(lengths, u)] for u in used]
        found.append((of, position, capacity))
    return min(found, key=lambda f: sum(f[2]) + overhead * len(f[2]))


def cut_pieces(docs: DataFrame, longest: int, size: Column, *keep: str) -> DataFrame:
    """doc_id, piece, start and words: every row's words in pieces of at most ``longest``."""
    sized = docs.select("doc_id", size.alias("size"), *keep)
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / longest))
    cut = sized.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * longest
    return cut.select("doc_id", F.col("piece").cast("long").alias("piece"), start.cast("long").alias("start"), F.least(F.lit(longest), F.col("size") - start).cast("long").alias("words"), *keep)


def _placed(rows: DataFrame, capacities: tuple[int, ...], overhead: float) -> DataFrame:
    """Places of the pieces of tagged rows with their size."""
    longest = max(capacities)
    cut = cut_pieces(rows, longest, F.col("size"), "tag")
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(1, (n + (size or 0) // (2 * longest)) // SHARD_PIECES)  # two bytes a word at least

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        doc, tag, piece, words = (table[c].to_numpy() for c in ("doc_id", "tag", "piece", "words"))
        table = table.take(pa.array(np.lexsort((tag, piece, doc, -words))))
        sizes = table["words"].to_pylist()
        full = next((i for i, s in enumerate(sizes) if not s), len(sizes))
        of, position, capacity = pack(sizes[:full], capacities, overhead)
        none = [None] * (len(sizes) - full)
        shard = key[0].as_py()
        return table.select(["doc_id", "tag", "piece", "start", "words"]).append_column("bin_id", pa.array([f"{shard}-{b}" for b in of] + none, pa.string())).append_column("capacity", pa.array([capacity[b] for b in of] + none, pa.int32())).append_column("position", pa.array(position + none, pa.int32()))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tag", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(fill, PLACED)


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, size: Column | None = None) -> DataFrame:
    """doc_id, piece, start, words, bin_id, capacity and position of every piece of every row."""
    sized = docs.select("doc_id", "text", (words_of() if size is None else size).alias("size"))
    placed = _placed(tagged(sized, "size", bits=62), capacities, overhead)
    return placed.select(named().alias("doc_id"), "piece", "start", "words", "bin_id", "capacity", "position")


def sequences(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD) -> DataFrame:
    """The packed bins: bin_id, capacity, words, doc_ids and pieces (their texts, in the bin's
    order). A row's text is cut at words, which keep the white space before them."""
    longest = max(capacities)
    rows = tagged(docs.select("doc_id", "text", words_of().alias("size")), "size", bits=62)
    placed = _placed(rows, capacities, overhead).filter("bin_id is not null")
    word = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    parts = rows.filter("size > 0").select("doc_id", "tag", "size", F.when(F.col("size") <= longest, F.array("text")).otherwise(word).alias("all"))
    pieces = F.when(F.col("size") <= longest, F.col("all")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / longest).cast("int")), lambda i: F.array_join(F.slice("all", i * longest + 1, F.lit(longest)), ""))
    )
    texts = parts.select("doc_id", "tag", F.posexplode(pieces).alias("number", "text")).withColumn("piece", F.col("number").cast("long")).drop("number")
    if rows.groupBy("doc_id", "tag").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "tag", "piece"])  # the texts of equal rows
    joined = placed.join(texts, ["doc_id", "tag", "piece"])
    row = F.struct("position", named().alias("doc_id"), "text", "words")
    bins = joined.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return bins.select("bin_id", "capacity", F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["words"]).alias("words"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.text").alias("pieces"))
