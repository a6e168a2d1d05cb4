"""Operator 6: repeated byte strings by blockwise suffix sorting with a difference cover.

A string of ``window`` bytes that also starts in a document with a smaller id is removed,
wherever it starts. Each window is dealt by its minimiser: the smallest hash among its
``KMER``-byte strings, the leftmost on ties. Windows with equal bytes have the same
minimiser at the same place, so they meet in one block, and neighbouring windows with one
minimiser travel as a single piece of text. Equal pieces of a task travel once, with the
ids that the task needs to answer them.

A block sorts its suffixes one bucket (a range of minimisers) at a time. Pieces are laid
out so that their minimisers fall on multiples of the cover's period, so equal windows have
equal residues; the suffixes that begin windows are ordered by the bytes before their first
cover place, the ranks of the cover places that span the rest, and the bytes behind them, and
repeats are read off neighbours. Suffixes that stand alone after the first bytes need no
further order. Ranks of cover places (difference cover
{0, 1, 3} modulo 7) come from sorting 7, 14 and 28 bytes by doubling, so that ties of any
length cost two integers and no block holds a text's whole suffix array. Everything is
compared exactly; hashes only deal the rows.

Very common passages: a minimiser's rows are all in one block, but pieces inside a shared
passage are equal and collapse in every task and again in the block's buckets, whose
rows are bounded by ``BUCKET_BYTES`` unless a single minimiser has more.

Defined results: a null text is empty; texts shorter than the window lose nothing; rows
with the same doc_id are one document's texts and never lose bytes to each other; rows
whose doc_id is null come after all others and lose nothing to each other; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NULL_FROM, PLACE_BITS, SLICE_BYTES, checkpoint, leftmost, let_go, numbers, packed, pieces, planes, release_shuffles, slices, small_batches, tagged, unpacked, utf8

WINDOW = 50
KMER = 16
PERIOD = 7
#: The difference cover: any two residues modulo 7 are met by a common shift into it.
COVER = np.array([True, True, False, True, False, False, False])
#: Text that a task gathers before it sends a block its pieces.
GATHERED = 6 << 20
#: Text of pieces whose suffixes are sorted together.
BUCKET_BYTES = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(3).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _kmer_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``KMER`` bytes from each place."""
    h = _TABLE[raw]
    for span in (1, 2, 4, KMER - 8):  # 2, 4, 8 and then KMER bytes
        h = h[:-span] * _MIX + h[span:]
        h ^= h >> np.uint64(29)
    return h * _MIX


def minimised(raw: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of a slice of texts: text number, start, first window after the last, place
    of the minimiser (all in the slice), and the minimiser's hash."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(raw) < window:
        return none
    hashed = _kmer_hashes(raw)
    at = leftmost(hashed, window - KMER + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + window <= offsets[1:][doc]
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    begins &= inside
    start = np.flatnonzero(begins)
    # a piece ends where the next begins or its text has no further window
    last = np.minimum(np.append(start[1:], len(at)), offsets[1:][doc[start]] - window + 1)
    return doc[start], start, last, at[start], hashed[at[start]] >> PLACE_BITS


def _gather(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(offsets[-1], np.uint8)
    for i, j in slices(offsets, SLICE_BYTES // 2):  # an index takes 8 bytes for each byte
        index = np.arange(offsets[i], offsets[j], dtype=np.int64)
        index += np.repeat(start[i:j] - offsets[i:j], length[i:j])
        out[offsets[i] : offsets[j]] = raw[index]
    return out, offsets


def _deal(blocks: int, window: int):
    """Sends each block the pieces of its minimisers: one row for each block and gathering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[tuple] = []
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            doc, place, count, ahead, mini, text_len = (np.concatenate([h[i] for h in held]) for i in range(6))
            texts = np.concatenate([h[6] for h in held])
            held.clear()
            offsets = np.concatenate([[0], np.cumsum(text_len)])
            block = (mini % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((place, doc, block))
            ends = np.searchsorted(block[order], np.arange(blocks + 1))
            for b in range(blocks):
                rows = order[ends[b] : ends[b + 1]]
                if not len(rows):
                    continue
                text, _ = _gather(texts, offsets[rows], text_len[rows])
                step = lambda x: np.diff(x, prepend=0)
                value = packed(planes(step(doc[rows])), planes(place[rows]), count[rows].astype(np.uint8), ahead[rows].astype(np.uint8), planes(mini[rows].view(np.int64)), text)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([value], pa.binary())], names=["block", "pieces"])

        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            raw, offsets = utf8(batch.column(1))
            for first, end in slices(offsets, SLICE_BYTES // 2):
                own, at = raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
                doc, start, last, mini_at, mini = minimised(own, at, window)
                length = last - start + window - 1
                text, _ = _gather(own, start, length)
                held.append((ids[first + doc], (start - at[doc]) | tags[first + doc] << 32, last - start, mini_at - start, mini, length, text))
                size += len(text)
                if size >= GATHERED:
                    yield from passed()
                    size = 0
        if held:
            yield from passed()
        let_go()

    return run


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of integers."""
    order = np.argsort(keys)
    of = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], of[1:] != of[:-1]])) if len(of) else 0
    return rank


def _names(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each window start an integer, equal just where ``window`` bytes and the start's
    residue modulo the cover's period are equal; windows that share their first bytes with
    another one are numbered in suffix order, by precomputed ranks of the cover's places."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    covered = np.flatnonzero(np.resize(COVER, n))
    slot = np.full(n + 64, -1, np.int64)
    slot[covered] = np.arange(len(covered))
    key = np.zeros(len(covered), np.uint64)
    for i in range(PERIOD):
        key = key << np.uint64(8) | padded[covered + i]
    rank, span = _ranks(key), PERIOD
    while span * 2 <= window - 2 * (PERIOD - 1):
        behind = slot[covered + span]
        rank = _ranks(rank << np.int64(32) | np.where(behind < 0, 0, rank[behind] + 1))
        span *= 2
    ahead = np.array([next(d for d in range(PERIOD) if COVER[(r + d) % PERIOD]) for r in range(PERIOD)])[at % PERIOD]
    name = rank[slot[at + ahead]]
    tied = np.bincount(name, minlength=1)[name] > 1 if len(at) else np.zeros(0, bool)
    if not tied.all():  # what stands alone after ``span`` bytes needs no further look
        out = np.arange(len(at))
        out[tied] = _told_apart(padded, at[tied], name[tied], ahead[tied], rank, slot, span, window) + len(at)
        return out
    return _told_apart(padded, at, name, ahead, rank, slot, span, window)


def _told_apart(padded: np.ndarray, at: np.ndarray, name: np.ndarray, ahead: np.ndarray, rank: np.ndarray, slot: np.ndarray, span: int, window: int) -> np.ndarray:
    """Places of whole windows in the order of suffixes, equal for equal windows, from ranks of
    ``span`` bytes from their first cover places: by residue, then by the bytes before that
    place, its rank, and the ranks of further cover places."""
    done = ahead + span  # bytes from each start that the name stands for
    head = np.zeros(len(at), np.int64)
    for i in range(PERIOD):
        head = np.where(i < ahead, head << 8 | padded[at + i], head)
    name = _ranks((at % PERIOD) << np.int64(56) | head << np.int64(32) | name) if len(at) else name
    while True:
        short = window - done
        if not (short > 0).any():
            return name
        # the last cover place from which ``span`` bytes stay inside the window and leave no gap
        to = np.minimum(done, window - span)
        back = np.array([next(d for d in range(PERIOD) if COVER[(r - d) % PERIOD]) for r in range(PERIOD)])[(at + to) % PERIOD]
        place = to - back
        gained = place + span > done
        more = np.where(gained, rank[slot[at + place]] + 1, 0)
        done = np.where(gained, place + span, done)
        tail = np.zeros(len(at), np.int64)
        if not gained.any():
            for i in range(int(short.max())):
                tail = np.where(i < short, tail << 8 | padded[at + np.minimum(done + i, window - 1)], tail)
            return _ranks(_ranks(name) << np.int64(31) | _ranks(tail))
        name = _ranks(name << np.int64(32) | more)


def _bucket(doc: np.ndarray, place: np.ndarray, count: np.ndarray, ahead: np.ndarray, text: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of removed windows (doc, first, last) of the pieces of one bucket."""
    length = np.diff(offsets)
    # equal pieces are sorted once: the smallest id of each stands for it
    view = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(text))])
    same = view.dictionary_encode().indices.to_numpy()
    kinds = int(same.max()) + 1
    rank = np.minimum(doc, NULL_FROM + 1)  # documents without an id come last, all at once
    smallest = np.full(kinds, np.iinfo(np.int64).max)
    np.minimum.at(smallest, same, rank)
    one = np.empty(kinds, np.int64)
    one[same[::-1]] = np.arange(len(same))[::-1]
    # lay the pieces out with their minimisers on multiples of the period
    pad = (-ahead[one]) % PERIOD
    room = -(-(pad + length[one]) // PERIOD) * PERIOD
    base = np.concatenate([[0], np.cumsum(room)])
    laid = np.zeros(base[-1], np.uint8)
    own, own_at = _gather(text, offsets[one], length[one])
    for i, j in slices(own_at, SLICE_BYTES // 2):
        laid[np.arange(own_at[i], own_at[j]) + np.repeat(base[i:j] + pad[i:j] - own_at[i:j], length[one[i:j]])] = own[own_at[i] : own_at[j]]
    n = count[one]
    first = np.concatenate([[0], np.cumsum(n)])
    windows = np.arange(first[-1]) + np.repeat(base[:-1] + pad - first[:-1], n)
    name = _names(laid, windows, window)
    order = np.argsort(name, kind="stable")  # repeats are neighbours in suffix order
    head = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]])[: len(order)])
    least = np.empty(len(name), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(np.repeat(smallest, n)[order], head), np.diff(np.append(head, len(order))))
    # runs of windows of each row for which a smaller id was found
    rows = np.flatnonzero((np.maximum.reduceat((least < np.iinfo(np.int64).max).astype(np.int8), first[:-1]) > 0)[same]) if len(first) > 1 else np.zeros(0, np.int64)
    low = np.minimum.reduceat(least, first[:-1])[same]
    rows = rows[low[rows] < rank[rows]]
    each = count[rows]
    start = np.concatenate([[0], np.cumsum(each)])
    index = np.arange(start[-1]) + np.repeat(first[:-1][same[rows]] - start[:-1], each)
    hit = least[index] < np.repeat(rank[rows], each)
    owner = np.repeat(np.arange(len(rows)), each)
    begins = hit.copy()
    begins[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    ends = hit.copy()
    ends[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    b, e = np.flatnonzero(begins), np.flatnonzero(ends)
    r = owner[b]
    at = place[rows[r]] - start[r]
    return doc[rows[r]], at + b, at + e


def _solve(window: int, parts: int):
    """Removed runs of a block, packed by parts of the documents."""

    def run(table: pa.Table) -> pa.Table:
        docs, places, counts, aheads, minis, filling = [], [], [], [], [], bytearray()
        for value in table["pieces"]:
            step, place, count, ahead, mini, own = unpacked(value.as_py(), np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8)
            docs.append(np.cumsum(numbers(step)))
            places.append(numbers(place))
            counts.append(count.copy())  # copies, so that the unpacked value can go
            aheads.append(ahead.copy())
            minis.append(numbers(mini))
            filling += memoryview(own)
        step = place = count = ahead = mini = own = None
        text = np.frombuffer(filling, np.uint8)
        mini, doc = np.concatenate(minis), np.concatenate(docs)
        del minis, docs
        place, count, ahead = np.concatenate(places), np.concatenate(counts), np.concatenate(aheads)
        del places, counts, aheads
        length = count.astype(np.int16) + np.int16(window - 1)
        offsets = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        order = np.lexsort((doc, mini))
        # a minimiser of a single document has nothing to remove
        m, d = mini[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        shared = np.repeat(d[starts] != d[np.append(starts[1:], len(d)) - 1], np.diff(np.append(starts, len(d))))
        order, m = order[shared], m[shared]
        del mini, d, starts, shared
        found: list[tuple] = []
        at = 0
        filled = np.concatenate([[0], np.cumsum(length[order], dtype=np.int64)])
        while at < len(order):
            end = int(np.searchsorted(filled, filled[at] + BUCKET_BYTES, "right")) - 1
            end = max(at + 1, min(end, len(order)))
            end = int(np.searchsorted(m, m[end - 1], "right"))  # whole minimisers
            rows = order[at:end]
            own, own_at = _gather(text, offsets[rows], length[rows].astype(np.int64))
            found.append(_bucket(doc[rows], place[rows], count[rows].astype(np.int64), ahead[rows].astype(np.int64), own, own_at, window))
            at = end
        del text, filling, offsets, order, m, filled, doc, place, count, ahead, length
        let_go()
        d, b, e = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((b, d))
        d, b, e = d[order], b[order], e[order]
        part = (_mixed(d) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        d, b, e = d[order], b[order], e[order]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, packed(planes(np.diff(d[i:j], prepend=0)), planes(b[i:j]), (e[i:j] - b[i:j]).astype(np.uint32))) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "found": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    return x ^ (x >> np.uint64(32))


def _by_document(table: pa.Table) -> pa.Table:
    """All runs of each document of a part, in one row."""
    ds, bs, extras = [], [], []
    for value in table["found"]:
        step, first, extra = unpacked(value.as_py(), np.uint8, np.uint8, np.uint32)
        ds.append(np.cumsum(numbers(step)))
        bs.append(numbers(first))
        extras.append(extra)
    d, b, extra = np.concatenate(ds), np.concatenate(bs), np.concatenate(extras)
    order = np.lexsort((b, d))
    d, b, extra = d[order], b[order], extra[order]
    tag = b >> 32
    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (tag[1:] != tag[:-1])]))
    runs = [np.stack([b[i:j] & 0xFFFFFFFF, extra[i:j]]).astype(np.uint32).tobytes() for i, j in zip(cut, np.append(cut[1:], len(d)))]
    return pa.table({"doc_id": pa.array(d[cut]), "tag": pa.array(tag[cut]), "runs": pa.array(runs, pa.binary())})


def removed_runs(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tag and runs (starts and extra lengths of runs of windows to remove, as 32-bit
    numbers) of each document that loses bytes, for rows of doc_id, text and tag."""
    if not 2 * KMER <= window <= KMER + 254:
        raise ValueError(f"window must be from {2 * KMER} to {KMER + 254} bytes")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.select("doc_id", "text", "tag").mapInArrow(_deal(pieces(size * 3.5, 16 << 20, 12), window), "block int, pieces binary")
    found = dealt.groupBy("block").applyInArrow(_solve(window, pieces(size, 32 << 20, 12)), "part int, found binary")
    return found.groupBy("part").applyInArrow(_by_document, "doc_id long, tag long, runs binary")


def spans_of(runs: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte ranges of a document from its runs."""
    both = np.frombuffer(runs, np.uint32).reshape(2, -1).astype(np.int64)
    start, end = both[0], np.maximum.accumulate(both[0] + both[1] + window)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]


def _joined(docs: DataFrame, window: int, *more: str) -> DataFrame:
    """Rows with their text and what is to be removed of it (column runs)."""
    small_batches(docs.sparkSession)
    rows = tagged(docs, *more)
    gone = checkpoint(removed_runs(rows, window))
    release_shuffles(docs.sparkSession)  # the pieces are as large as the input; texts are dealt next
    return rows.join(gone, ["doc_id", "tag"], "left")


def _kept(text: str | None, runs: bytes | None, window: int) -> tuple[int, int, int, bytes]:
    """Bytes of a text, bytes and spans removed, and the bytes that stay."""
    raw = (text or "").encode("utf-8")
    if not runs:
        return len(raw), 0, 0, raw
    starts, ends = spans_of(runs, window)
    edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist()) for x in pair), len(raw)]
    return len(raw), int((ends - starts).sum()), len(starts), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, runs = (batch.column(i).to_pylist() for i in range(3))
            found = [_kept(t, r, window) for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if i > NULL_FROM else i for i in ids], pa.int64()), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(f[3]).hexdigest() for f in found], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _joined(docs, window).select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with what stays of their texts; a character that loses some of
    its bytes goes whole, a null text stays null, and n_chars follows the new text."""
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("whole_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = (batch.column(i).to_pylist() for i in (0, 1))
            kept = [None if t is None else t if not r else _kept(t, r, window)[3].decode("utf-8", "ignore") for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(2)], names=["text", "whole_row"])

    joined = _joined(whole, window, "whole_row").select("text", "runs", "whole_row")
    schema = joined.select("text", "whole_row").schema
    made = joined.mapInArrow(run, schema)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return made.select(*(new[c].alias(c) if c in new else F.col(f"whole_row.`{c}`").alias(c) for c in docs.columns))
