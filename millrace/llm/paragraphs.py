"""Operator 10: near-duplicate paragraphs by MinHash bands.

A paragraph is a line of at least ``LEAST`` words, or a run of ``LEAST`` words that begins
at an anchor. Anchors are places that the words themselves choose, the smallest hash of a
word shingle among each ``GAP`` neighbours, so they fall alike wherever a passage stands:
every run of ``LEAST + GAP - 1`` (51) words holds a whole paragraph, within a line or across
lines, and words that many texts share but that are fewer than ``LEAST`` in a row are none.

Shingles are runs of ``width`` words, without regard to the case of A-Z or the kind of white
space. Equal paragraphs (128 bits of hash over their words) are one class, named by its
first paragraph by (doc_id, place). Bands of MinHash values are tuned so that a pair at the
wanted similarity meets in a band with probability ``recall``; the fewest hashes that do so
are taken. Classes that meet in a band, and only those, have their shingles read again and
compared exactly by Jaccard similarity; classes whose first paragraphs stand in one document
(a line and the runs within it) are not. The components of the links are the clusters. A
paragraph goes if the first of its cluster stands in a document with a smaller id; what
stays is the first.

A task sends each block its paragraphs' keys and band values as compressed arrays, equal
paragraphs once, so a very common one costs a block one entry from each task. Groups that
several bands share are compared once; a group of many classes is cut into tiles, and each
pair of tiles compared in a task of its own. A group passes on a spanning star of its links.

Defined results: null, empty and short texts have no paragraphs; a text loses nothing to
itself; all texts of one doc_id are one document's, told apart by a hash, and lose nothing
to each other; rows that repeat an id and a text lose the same words; rows with a null
doc_id come after all others and lose nothing to each other; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NULL_FROM, checkpoint, join_counted, leftmost, named, numbers, packed, pieces, planes, release_shuffles, slices, tagged, unpacked, utf8
from millrace.llm.components import components, local_roots

WIDTH, SIMILAR, RECALL = 5, 0.8, 0.99
#: Fewest words of a paragraph, and neighbouring places of which one is an anchor.
LEAST, GAP = 25, 27
TILE = 4096
#: Text whose paragraphs a task gathers before it sends them.
GATHERED = 16 << 20
#: Bytes of a band value and of a key that are sent; the block stands for further bits.
VALUE_BYTES, KEY_BYTES = 5, 6
_RNG = np.random.default_rng(17)
_BYTE = _RNG.integers(1 << 62, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
NODE = "struct<doc_id: long, place: long>"


def tuned(similar: float = SIMILAR, recall: float = RECALL, most_rows: int = 8) -> tuple[int, int]:
    """Bands and rows of a band: the fewest hashes that reach the recall at the similarity,
    among shapes that let at most half of the pairs at half the similarity meet."""
    shapes = []
    for rows in range(1, most_rows + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similar**rows)))
        loose = 1 - (1 - (similar / 2) ** rows) ** bands
        shapes.append((loose > 0.5, bands * rows, bands, rows))
    return min(shapes)[2:]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _folded()


def _spread(start: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs of ``each`` from ``start``, one after the other, and where each run begins."""
    first = np.concatenate([[0], np.cumsum(each)])
    return np.arange(first[-1]) + np.repeat(start - first[:-1], each), first


class Paragraphs:
    """The paragraphs of a slice of texts: number of their text, first word in it, words,
    whether they are a line, 128-bit key, and shingles from ``first`` on."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, least: int = LEAST, gap: int = GAP):
        raw = _LOWER[raw]
        self.doc = self.start = self.words = self.line = np.zeros(0, np.int64)
        self.key, self.shingles, self.first = np.zeros((0, 2), np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
        at, text = word_starts(raw, offsets)
        if len(at) < least:
            return
        words = _word_hashes(raw, at)
        breaks = np.concatenate([[0], np.cumsum(raw == 10)])[at]
        head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (breaks[1:] != breaks[:-1])]))
        count = np.diff(np.append(head, len(at)))
        head, count = head[count >= least], count[count >= least]
        run = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            run = _mixed(run * _MIX + words[i : i + len(run)])
        anchors = np.zeros(0, np.int64)
        if len(run) >= gap:
            chosen = leftmost(run, gap)
            ends = np.searchsorted(text, np.arange(len(offsets) - 1), "right")
            inside = np.arange(len(chosen)) + gap - 1 + least <= ends[text[: len(chosen)]]
            anchors = np.unique(chosen[inside])
        begin = np.concatenate([head, anchors])
        self.words = np.concatenate([count, np.full(len(anchors), least)])
        self.line = np.repeat([1, 0], [len(head), len(anchors)])
        self.doc = text[begin]
        self.start = begin - np.searchsorted(text, np.arange(len(offsets) - 1))[self.doc]
        if not len(begin):
            return
        place, first = _spread(begin, self.words)
        order = _mixed(words[place] + ((np.arange(len(place)) - np.repeat(first[:-1], self.words)).astype(np.uint64) << np.uint64(1)) * _MIX)
        self.key = np.stack([np.add.reduceat(order, first[:-1]), np.add.reduceat(_mixed(order + np.uint64(1)), first[:-1])], axis=1)
        place, self.first = _spread(begin, self.words - width + 1)
        self.shingles = run[place]

    def place(self) -> np.ndarray:
        """First word and kind as one number."""
        return self.start << 1 | self.line


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word of a slice of texts, and the word's text."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    starts_text = offsets[:-1][np.diff(offsets) > 0]
    begins[starts_text] |= ~blank[starts_text]
    at = np.flatnonzero(begins)
    return at, np.searchsorted(offsets, at, "right") - 1


def _word_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    place = np.arange(at[0], len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))))
    value = np.where(blank[at[0] :], 0, _mixed(_BYTE[0][raw[at[0] :]] * _STEP[place & 63] + (place >> 6).astype(np.uint64)))
    return _mixed(np.add.reduceat(value, at - at[0]))


def _bands(found: Paragraphs, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each paragraph and band."""
    out = np.zeros((len(found.doc), bands), np.uint64)
    if not len(out):
        return out
    rng = np.random.default_rng(23)
    odd = rng.integers(1 << 62, size=(bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    folded = found.shingles ^ (found.shingles >> np.uint64(32))
    for band in range(bands):
        for row in range(rows):
            least = np.minimum.reduceat(folded * odd[band, row], found.first[:-1])
            out[:, band] = _mixed(out[:, band] * _MIX + least)
    return out


def _blocks_of(block: np.ndarray, order: np.ndarray, blocks: int) -> np.ndarray:
    return np.searchsorted(block[order], np.arange(blocks + 1))


def _deal(blocks: int, width: int, bands: int, rows: int):
    """Sends each block the keys and the band values that fall to it, each with the first
    paragraph of its class in what was gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            doc, place, a, b, values = (np.concatenate([h[i] for h in held]) for i in range(5))
            held.clear()
            order = np.lexsort((place, doc, b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(order)]
            one = order[new]
            last = order[np.append(np.flatnonzero(new)[1:], len(order)) - 1] if len(order) else order
            many = (doc[last] != doc[one]).astype(np.uint8)
            doc, place, a, b, values = doc[one], place[one], a[one], b[one], values[one]
            n = len(one)
            values = _mixed(values + np.arange(bands, dtype=np.uint64)).ravel()
            of = np.repeat(np.arange(n), bands)
            whole, part = (a % np.uint64(blocks)).astype(np.int64), (values % np.uint64(blocks)).astype(np.int64)
            values //= np.uint64(blocks)
            exact, near = np.lexsort((place, doc, whole)), np.lexsort((place[of], doc[of], part))
            exact_ends, near_ends = _blocks_of(whole, exact, blocks), _blocks_of(part, near, blocks)
            for number in range(blocks):
                x, y = exact[exact_ends[number] : exact_ends[number + 1]], near[near_ends[number] : near_ends[number + 1]]
                if not len(x) + len(y):
                    continue
                z = of[y]
                value = packed(
                    planes(np.diff(doc[x], prepend=0)), planes(place[x]), planes(a[x].view(np.int64)), planes(b[x].view(np.int64)), many[x],
                    planes(np.diff(doc[z], prepend=0)), planes(place[z]), planes(a[z].view(np.int64))[:KEY_BYTES], planes(values[y].view(np.int64))[:VALUE_BYTES],
                )
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([value], pa.binary())], names=["block", "packed"])

        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            raw, offsets = utf8(batch.column(1))
            for first, end in slices(offsets):
                found = Paragraphs(raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], width)
                held.append((ids[first + found.doc], tags[first + found.doc] << 33 | found.place(), found.key[:, 0], found.key[:, 1], _bands(found, bands, rows)))
                size += offsets[end] - offsets[first]
                if size >= GATHERED:
                    yield from passed()
                    size = 0
        if held:
            yield from passed()

    return run


def _widened(some: np.ndarray, count: int) -> np.ndarray:
    """Numbers whose first ``count`` byte planes were sent."""
    return numbers(np.concatenate([some, np.zeros((8 - count) * (len(some) // count), np.uint8)]))


def _meetings(key: tuple, table: pa.Table) -> pa.Table:
    """Classes of more than one paragraph (a, b), and the classes of each band value whose
    first paragraphs stand in different documents (meeting), each by its first paragraph."""
    parts: list[list[np.ndarray]] = [[] for _ in range(9)]
    for value in table["packed"]:
        got = unpacked(value.as_py(), *[np.uint8] * 9)
        doc, place, a, b, many, near, where, keys, values = got
        for i, x in enumerate((np.cumsum(numbers(doc)), numbers(place), numbers(a), numbers(b), many, np.cumsum(numbers(near)), numbers(where), _widened(keys, KEY_BYTES), _widened(values, VALUE_BYTES))):
            parts[i].append(x)
    doc, place, a, b, many, near, where, keys, values = (np.concatenate(p) for p in parts)
    order = np.lexsort((place, doc, b, a))
    a, b, doc, place, many = a[order], b[order], doc[order], place[order], many[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    several = (np.diff(np.append(head, len(a))) > 1) | (np.maximum.reduceat(many, head) > 0 if len(head) else np.zeros(0, bool))
    head = head[several]
    order = np.lexsort((where, near, keys, values))
    keys, values, near, where = keys[order], values[order], near[order], where[order]
    kinds = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (keys[1:] != keys[:-1])])[: len(keys)])
    values, near, where = values[kinds], near[kinds], where[kinds]
    groups = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    apart = np.minimum.reduceat(near, groups) != np.maximum.reduceat(near, groups) if len(groups) else np.zeros(0, bool)
    met = np.repeat(apart, np.diff(np.append(groups, len(values))))
    meeting = _mixed(values[met].view(np.uint64) + _mixed(np.array([key[0].as_py()], np.uint64))).view(np.int64)
    blank = lambda n: pa.nulls(n, pa.int64())
    return pa.table({
        "meeting": pa.chunked_array([blank(len(head)), pa.array(meeting)]),
        "doc_id": np.concatenate([doc[head], near[met]]),
        "place": np.concatenate([place[head], where[met]]),
        "a": pa.chunked_array([pa.array(a[head]), blank(len(meeting))]),
        "b": pa.chunked_array([pa.array(b[head]), blank(len(meeting))]),
    })


def _reread(width: int):
    """Keys and shingles (sorted, without repeats) of chosen paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            raw, offsets = utf8(batch.column(1))
            for start, end in slices(offsets):
                found = Paragraphs(raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], width)
                chosen = [{w & ((1 << 33) - 1): w for w in some} for some in wanted[start:end]]
                places = [chosen[d].get(p) for d, p in zip(found.doc.tolist(), found.place().tolist())]
                rows = [i for i, p in enumerate(places) if p is not None]
                sets = [np.unique(found.shingles[found.first[i] : found.first[i + 1]]).tobytes() for i in rows]
                key = found.key[rows].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[start + found.doc[rows]], pa.int64()), pa.array([places[i] for i in rows], pa.int64()), *(pa.array(np.ascontiguousarray(key[:, i])) for i in (0, 1)), pa.array(sets, pa.binary())], names=["doc_id", "place", "a", "b", "shingles"])

    return run


def _linked(similar: float, first: str = "doc_id", second: str = "place", apart: bool = False):
    """Spanning links of the classes of a meeting that are similar enough, and, if they are
    to be ``apart``, differ in the first of the two columns of longs that name a class."""

    def compare(sets: list[np.ndarray], own: np.ndarray) -> list[tuple[int, int]]:
        n = len(sets)
        if n == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return [(0, 1)] if both >= similar * (len(sets[0]) + len(sets[1]) - both) and not (apart and own[0] == own[1]) else []
        size = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        unseen = np.ones(n, bool)
        found: list[tuple[int, int]] = []
        for seed in range(n):
            if not unseen[seed]:
                continue
            unseen[seed] = False
            reached = [seed]
            while reached:
                one = reached.pop()
                left = np.searchsorted(flat, sets[one])
                right = np.searchsorted(flat, sets[one], "right")
                each = right - left
                hits = owner[np.arange(each.sum()) + np.repeat(left - np.concatenate([[0], np.cumsum(each)[:-1]]), each)]
                both = np.bincount(hits, minlength=n)
                close = unseen & (both >= similar * (size + size[one] - both))
                near = np.flatnonzero(close & (own != own[one]) if apart else close)
                unseen[near] = False
                found += [(one, int(j)) for j in near]
                reached += near.tolist()
                left = unseen[owner]
                if 2 * left.sum() < len(owner):  # what was reached is not looked for again
                    flat, owner = flat[left], owner[left]
        return found

    def run(table: pa.Table) -> pa.Table:
        meeting, one, two = (table[c].to_numpy() for c in ("key", first, second))
        sets = table["shingles"].to_pylist()
        order = np.lexsort((two, one, meeting))
        ends = np.append(np.flatnonzero(np.concatenate([[True], meeting[order][1:] != meeting[order][:-1]])), len(order))
        out: list[tuple[int, int]] = []
        for a, b in zip(ends[:-1], ends[1:]):
            rows = order[a:b]
            if b - a > 1:
                out += [(int(rows[i]), int(rows[j])) for i, j in compare([np.frombuffer(sets[r], np.uint64) for r in rows], one[rows])]
        # of all links of this task a spanning star stays
        code = np.unique(np.stack([one, two], axis=1), axis=0, return_inverse=True)
        nodes, node = code[0], code[1].ravel()
        u, v = np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)
        root = local_roots(len(nodes), node[u], node[v])
        kept = np.flatnonzero(root != np.arange(len(nodes)))
        pick = lambda rows: pa.StructArray.from_arrays([pa.array(nodes[rows, 0]), pa.array(nodes[rows, 1])], names=[first, second])
        return pa.table({"u": pick(kept), "v": pick(root[kept])})

    return run


def _standing(width: int):
    """Where every paragraph stands, under its class's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            raw, offsets = utf8(batch.column(1))
            for start, end in slices(offsets):
                found = Paragraphs(raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], width)
                key = found.key.view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(key[:, i])) for i in (0, 1)), pa.array(ids[start + found.doc]), pa.array(tags[start + found.doc]), pa.array(found.start), pa.array(found.words.astype(np.int64))], names=["a", "b", "doc_id", "tag", "start", "words"])

    return run


def duplicates(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """doc_id and tag (as of ``tagged``), start and words of every paragraph that
    goes, and kept_doc_id, where the first of its cluster stands."""
    bands, rows = tuned(similar, recall)
    texts = tagged(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = texts.select("doc_id", "text", "tag").mapInArrow(_deal(pieces(size * 1.2, 16 << 20, 12), width, bands, rows), "block int, packed binary")
    met = checkpoint(dealt.groupBy("block").applyInArrow(_meetings, "meeting long, doc_id long, place long, a long, b long"))
    release_shuffles(docs.sparkSession)
    several = met.filter("meeting is null").select("a", "b", "doc_id", "place")
    near = met.filter("meeting is not null").select("meeting", "doc_id", "place")
    # the same classes often meet in several bands: one meeting of each set of classes is compared
    groups = near.groupBy("meeting").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "place").cast("decimal(20,0)")).alias("of"), F.sum(F.xxhash64("place", "doc_id").cast("decimal(20,0)")).alias("too"))
    groups = groups.groupBy("n", "of", "too").agg(F.min("meeting").alias("meeting")).select("meeting", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    near = checkpoint(join_counted(near, groups, ["meeting"]))
    wanted = near.select("doc_id", "place").distinct().groupBy("doc_id", F.shiftright("place", 33).alias("tag")).agg(F.collect_list("place").alias("places"))
    chosen = join_counted(texts, wanted, ["doc_id", "tag"]).select("doc_id", "text", "places")
    sets = checkpoint(chosen.mapInArrow(_reread(width), "doc_id long, place long, a long, b long, shingles binary").dropDuplicates(["doc_id", "place"]))
    release_shuffles(docs.sparkSession)
    own = F.pmod(F.xxhash64("doc_id", "place"), F.col("tiles")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    tiled = near.select("doc_id", "place", F.explode(cells).alias("cell"), "meeting").withColumn("key", F.xxhash64("meeting", "cell.i", "cell.j"))
    parts = pieces(near.count() * 400, 8 << 20, 12)
    keyed = tiled.join(sets.select("doc_id", "place", "shingles"), ["doc_id", "place"]).select("key", "doc_id", "place", "shingles", F.pmod("key", F.lit(parts)).alias("part"))
    roots = checkpoint(components(keyed.groupBy("part").applyInArrow(_linked(similar, apart=True), f"u {NODE}, v {NODE}")).select("node.doc_id", "node.place", F.col("root.doc_id").alias("kept_doc_id")))
    linked = sets.select("a", "b", "doc_id", "place").join(roots, ["doc_id", "place"])
    alone = several.join(roots, ["doc_id", "place"], "left").withColumn("kept_doc_id", F.coalesce("kept_doc_id", "doc_id"))
    kept = linked.unionByName(alone).select("a", "b", "kept_doc_id").distinct()
    standing = texts.select("doc_id", "text", "tag").mapInArrow(_standing(width), "a long, b long, doc_id long, tag long, start long, words long")
    return join_counted(standing, kept, ["a", "b"]).filter(F.col("kept_doc_id") < F.least("doc_id", F.lit(NULL_FROM + 1))).select("doc_id", "tag", "start", "words", "kept_doc_id")


def spans_of(gone: list[dict]) -> list[tuple[int, int, int]]:
    """Maximal spans (first word, end, smallest kept doc_id) of paragraphs that go."""
    out: list[list[int]] = []
    for start, end, kept in sorted((g["start"], g["start"] + g["words"], g["kept_doc_id"]) for g in gone):
        if out and start <= out[-1][1]:
            out[-1][1:] = max(out[-1][1], end), min(out[-1][2], kept)
        else:
            out.append([start, end, kept])
    return [tuple(x) for x in out]


SPANS = "array<struct<start: long, end: long, kept_doc_id: long>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept_doc_id", pa.int64())]))
    for batch in batches:
        removed = [[dict(zip(("start", "end", "kept_doc_id"), s)) for s in spans_of(gone)] for gone in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, kind)], names=["id", "id_tag", "removed"])


def _joined(docs: DataFrame, width: int, similar: float, recall: float, *more: str) -> DataFrame:
    """Rows of doc_id, text and more, with the spans that go (null: none)."""
    gone = duplicates(docs, width, similar, recall).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "words", "kept_doc_id")).alias("gone"))
    spans = gone.select("doc_id", "tag", "gone").mapInArrow(_spans, f"id long, id_tag long, removed {SPANS}")
    rows = tagged(docs, *more)
    return rows.join(spans, (F.col("doc_id") == F.col("id")) & (F.col("tag") == F.col("id_tag")), "left")


def removals(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """Each row's doc_id, n_bytes of its text, n_removed words in n_spans spans, and removed:
    the spans (first word and the one after the last, counted from 0), each with the
    smallest doc_id that keeps such a paragraph."""
    none = F.from_json(F.lit("[]"), SPANS)
    words = F.aggregate(F.coalesce("removed", none), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return _joined(docs, width, similar, recall).select(
        named().alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        words.alias("n_removed"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("removed", none).alias("removed"),
    )


def cut_documents(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without the words that go; a word goes with the white space behind it."""
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("whole_row"))

    def kept(text: str | None, removed: list | None) -> str | None:
        if not removed:
            return text
        raw = text.encode("utf-8")
        array = np.frombuffer(raw, np.uint8)
        at = np.append(word_starts(array, np.array([0, len(raw)]))[0], len(raw)).tolist()
        edges = [0, *(at[x] for s in removed for x in (s["start"], s["end"])), len(raw)]
        return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept(t, r) for t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], names=["text", "whole_row"])

    joined = _joined(whole, width, similar, recall, "whole_row").select("text", "removed", "whole_row")
    made = joined.mapInArrow(run, joined.select("text", "whole_row").schema)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return made.select(*(new[c].alias(c) if c in new else F.col(f"whole_row.`{c}`").alias(c) for c in docs.columns))
