"""Operator 4: SimHash near duplicates by a generalised pigeonhole.

Fingerprints have 64 bits. Equal ones are one node, so copies cost nothing beyond their
row. Bits that go together over all fingerprints are put into the same of eight groups of
8. From the groups' value counts, the number of pairs at each distance within a group is
known exactly, and a dynamic program joins neighbouring groups into partitions and gives
each partition a threshold so that the estimated work is least; more fingerprints give
fewer and larger partitions. If two fingerprints differ
in at most k bits and the thresholds plus one add up to k + 1, some partition differs in
no more than its threshold; so probing each partition within its threshold loses no link.
A probe's key is a partition's value with up to threshold bits flipped. Rows of a key are
compared where they meet; a key with many rows is cut into tiles and every pair of tiles
compared in a task of its own. Each task passes on a spanning star of what it linked, so
that a group of g near copies gives about g rows and not g * g.

For larger k, 64 bits alone would link unrelated texts; ``checked`` then takes 64 further
bits of each text and the most bits that all 128 may differ in. ``keep_one`` uses such
links only to find which sets of shingles meet, and compares these exactly, pair by pair,
before anything is connected.

For such k the probes of bits thin out too little: at 17 of 64, two unrelated texts share half a
probe on average, so what is compared grows with the square of the texts. As ``keep_one`` asks for a
Jaccard similarity besides, its fingerprints are dealt by shingles instead: two sets of which
``percent`` of a hundred are the same have a common element among the first hundredths that are
left, and one more, of each, in whatever order all sets share. That order is the rarest first, by
counts over a bounded number of documents, so that few texts meet for a common line; it decides
what meets where, and never what is linked. Fingerprints that share such a shingle are compared.

Defined results: null and empty texts have no words and fingerprint zero, which links like
any other; an empty table gives an empty result; repeated rows share a fingerprint, and a
null doc_id takes part but never names a component unless it has only null ids.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, join_counted, let_go, pieces, sieve, slices, small_batches, utf8
from millrace.llm.components import components, local_roots
from millrace.llm.jaccard_join import Known, known_points, met, named_set, packed_point, sets_of, sid

BITS, GROUP, SEED = 64, 8, 42
#: Rows of one key that meet in one task; more are cut into tiles.
TILE = 32768
#: What one probe row costs against one comparison of two fingerprints.
PROBE_COST = 600.0
#: About how many documents' shingles are counted, from how many on one is common, and the most of these.
COUNTED, COMMON, MOST_COMMON = 1 << 13, 4, 1 << 18
#: Bytes of keys that a task takes, and entries that it deals, at a time.
DEALT_BYTES, DEALT = 4 << 20, 1 << 20
#: What is dealt for each of a set's keys.
ENTRY = np.dtype([("key", "<u8"), ("fp", "<i8"), ("fq", "<i8"), ("n", "<i4")])


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """A hash of each word shingle of a text; one of fewer words is a single shingle."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1 :])], "<u8")


def fingerprint(raw: bytes, width: int) -> int:
    """Bits set in over half of the hashes of a text's word shingles."""
    hashed = shingle_hashes(raw, width)
    return _majority(hashed) if len(hashed) else 0


def _further(hashed: np.ndarray) -> np.ndarray:
    """Other hashes, made from those."""
    return (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def set_fingerprint(hashed: np.ndarray) -> tuple[int, int]:
    """64 bits, and 64 more, of a set of hashes: those set in most. Where as many have a bit
    as have not, the smallest hash tells, so that bits of few shingles are as often set as not."""
    if not len(hashed):
        return 0, 0
    odd = lambda x: np.append(x, x.min()) if len(x) % 2 == 0 else x
    return _majority(odd(hashed)), _majority(odd(_further(hashed)))


def _majority(hashed: np.ndarray) -> int:
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashed), 1 << 14):
        votes += np.unpackbits(hashed[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) and fq (zero) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py().encode("utf-8"), width) if t.is_valid else 0 for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(np.zeros_like(found))], names=["doc_id", "fp", "fq"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, fq long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        for at in range(0, len(batch), 1 << 15):
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False)[at : at + (1 << 15)].copy()).astype(np.float32)
            total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])


def group_bits(nodes: DataFrame, n: int) -> list[list[int]]:
    """Groups of 8 bits; a group grows by the bit that goes most with those it has."""
    cells = nodes.select("fp").mapInArrow(_together, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()
    both = np.zeros(BITS * BITS)
    for cell, count in cells:
        both[cell] = count
    both = both.reshape(BITS, BITS) / max(1, n)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tied = np.abs(both - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    while left:
        seed = max(left, key=lambda b: (abs(p[b] - 0.5), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < GROUP:
            best = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def _values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
    return out


def _pair_distances(nodes: DataFrame, groups: list[list[int]], most: int) -> np.ndarray:
    """For each group the number of ordered pairs at distance 0 to ``most``, from counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(groups), 1 << GROUP), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for g, bits in enumerate(groups):
                counts[g] += np.bincount(_values(fp, bits).astype(np.int64), minlength=1 << GROUP)
        g, v = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(counts[g, v])], names=["g", "v", "n"])

    rows = nodes.select("fp").mapInArrow(run, "g int, v int, n long").groupBy("g", "v").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(groups), 1 << GROUP))
    counts[rows["g"].to_numpy(), rows["v"].to_numpy()] = rows["n"].to_numpy()
    out = np.zeros((len(groups), most + 1))
    every = np.arange(1 << GROUP)
    for d in range(most + 1):
        for flipped in itertools.combinations(range(GROUP), d):
            out[:, d] += (counts * counts[:, every ^ sum(1 << b for b in flipped)]).sum(axis=1)
    return out


def allocate(distances: np.ndarray, n: int, k: int) -> list[tuple[list[int], int]]:
    """Partitions (lists of groups) with their thresholds, at the least estimated work.

    A dynamic program over the groups in order and the units left: a partition of some
    neighbouring groups with threshold t uses t + 1 of k + 1 units; one that uses none is
    not probed. The work of a partition is its probes and the pairs within its threshold,
    where groups that are joined are taken as independent of each other.
    """
    total = float(max(1, n)) ** 2
    share = distances / total

    def work(groups: range, t: int) -> float:
        near = np.array([1.0])
        for g in groups:
            near = np.convolve(near, share[g])[: k + 1]
        probes = sum(comb(GROUP * len(groups), d) for d in range(t + 1))
        return PROBE_COST * n * (1 + probes) / 2 + total * near[: t + 1].sum() / 2

    count = len(distances)
    best: dict[tuple[int, int], tuple[float, list]] = {(0, k + 1): (0.0, [])}
    for g in range(count):
        for left in range(k + 2):
            if (g, left) not in best:
                continue
            cost, chosen = best[g, left]
            for end in range(g + 1, count + 1):
                for units in range(left + 1):
                    more = work(range(g, end), units - 1) if units else 0.0
                    to = end, left - units
                    if to not in best or cost + more < best[to][0]:
                        best[to] = cost + more, [*chosen, (list(range(g, end)), units - 1)]
    return [part for part in best[count, 0][1] if part[1] >= 0]


def _flips(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in flipped) for d in range(1, t + 1) for flipped in itertools.combinations(range(width), d)], np.uint64)


def _link(fp: np.ndarray, fq: np.ndarray, key: np.ndarray, side: np.ndarray, k: int, checked: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are linked within a key, as spanning stars over the fingerprints; ``side``
    marks what is compared: rows of side 0 with all of their key, others with side 0 only."""
    order = np.lexsort((fq, fp, side, key))
    key, side = key[order], side[order]
    n, bits, more = len(order), fp[order].view(np.uint64), fq[order].view(np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], n]
    home = np.add.reduceat((side == 0).astype(np.int64), starts)
    us, vs = [], []
    sizes = ends - starts
    small = np.repeat((sizes > 1) & (sizes <= 64) & (home > 0), sizes)
    stop = np.repeat(ends, sizes)

    at = np.flatnonzero(small & (side == 0))
    shift = 1
    while len(at):  # each row against the one ``shift`` places on
        at = at[at + shift < stop[at]]
        first, second = np.bitwise_count(bits[at] ^ bits[at + shift]), np.bitwise_count(more[at] ^ more[at + shift])
        near = at[(first <= k) & (first + second <= checked)]
        us.append(near)
        vs.append(near + shift)
        shift += 1
    for s, e, h in zip(starts, ends, home):
        if e - s <= 64 or not h:
            continue
        for a in range(s, s + h, 128):  # blocks of rows, of which only a spanning star stays
            rows = np.arange(a, min(a + 128, s + h))
            i, j = np.nonzero(np.bitwise_count(bits[rows][:, None] ^ bits[None, a:e]) <= k)
            near = np.bitwise_count(bits[rows[i]] ^ bits[a + j]) + np.bitwise_count(more[rows[i]] ^ more[a + j]) <= checked
            i, j = i[near], j[near]
            apart = i != j
            i, j = i[apart], j[apart]
            if len(i):
                touched, where = np.unique(np.concatenate([i, j]), return_inverse=True)
                root = local_roots(len(touched), where[: len(i)], where[len(i) :])
                kept = np.flatnonzero(root != np.arange(len(touched)))
                us.append(touched[kept] + a)
                vs.append(touched[root[kept]] + a)
    return _stars(bits, more, us, vs)


def _stars(bits: np.ndarray, more: np.ndarray, us: list[np.ndarray], vs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars over the fingerprints of linked rows; rows of equal ones are one node."""
    u, v = (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    both = np.stack([bits[rows], more[rows]], axis=1)
    nodes, node = np.unique(both, axis=0, return_inverse=True) if len(rows) else (both, where)
    node = node.ravel()
    root = local_roots(len(nodes), node[where[: len(u)]], node[where[len(u) :]])
    kept = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[kept].view(np.int64), nodes[root[kept]].view(np.int64)


NODE = "struct<fp: long, fq: long>"


def _dealt(nodes: DataFrame, n: int, k: int) -> DataFrame:
    """Probes (fp, fq, side, key) of the fingerprints, dealt to buckets of whole keys."""
    groups = group_bits(nodes, n)
    parts = [([b for g in of for b in groups[g]], t) for of, t in allocate(_pair_distances(nodes, groups, k), n, k)]
    probes = sum(1 + len(_flips(len(bits), t)) // 2 for bits, t in parts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, further = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(every), 2048):
                fp, fq = every[at : at + 2048], further[at : at + 2048]
                for number, (bits, t) in enumerate(parts):
                    value = _values(fp.view(np.uint64), bits)
                    probe = value[:, None] ^ _flips(len(bits), t)[None, :]
                    row, col = np.nonzero(probe > value[:, None])  # the other direction finds the same pairs
                    row_all = np.concatenate([np.arange(len(fp)), row])
                    values = np.concatenate([value, probe[row, col]]).view(np.int64)
                    side = np.concatenate([np.zeros(len(fp), np.int8), np.ones(len(row), np.int8)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), number, np.int8)), pa.array(values), pa.array(side), pa.array(fp[row_all]), pa.array(fq[row_all])], names=["part", "value", "side", "fp", "fq"])

    signed = nodes.select("fp", "fq").mapInArrow(sign, "part byte, value long, side byte, fp long, fq long")
    hot = signed.groupBy("part", "value").count().filter(F.col("count") > TILE).select("part", "value", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tiled = join_counted(signed, hot, ["part", "value"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "fq"), F.col("tiles")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    keyed = tiled.select("fp", "fq", "side", F.explode(cells).alias("cell"), "part", "value").select("fp", "fq", "side", F.xxhash64("part", "value", "cell.i", "cell.j").alias("key"))
    buckets = pieces(n * probes * 25, 8 << 20, 12)

    return keyed.withColumn("bucket", F.pmod("key", F.lit(buckets)))


def links(nodes: DataFrame, n: int, k: int, checked: int | None = None) -> DataFrame:
    """u, v: edges that connect whatever fingerprints (columns fp and fq, distinct) within k
    bits of fp, and ``checked`` bits of both, connect."""
    most = k if checked is None else checked

    def compare(table: pa.Table) -> pa.Table:
        u, v = _link(*(table[c].to_numpy() for c in ("fp", "fq", "key", "side")), k, most)
        node = lambda x: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["fp", "fq"])
        return pa.table({"u": node(u), "v": node(v)})

    return _dealt(nodes, n, k).groupBy("bucket").applyInArrow(compare, f"u {NODE}, v {NODE}")


def _clusters(u: np.ndarray, v: np.ndarray) -> pa.Table:
    """key, fp, fq of the fingerprints of spanning stars; a key is of a cluster's members, so
    that a cluster that is found again has the same."""
    both = np.concatenate([np.stack([u, v], axis=1), np.stack([np.unique(v, axis=0)] * 2, axis=1)])  # each, and the first of its cluster
    own, first = both[:, 0].view(np.uint64), both[:, 1]
    _, cluster = np.unique(first, axis=0, return_inverse=True) if len(both) else (None, np.zeros(0, np.int64))
    total = np.zeros(int(cluster.max(initial=-1)) + 1, np.uint64)
    np.add.at(total, cluster.ravel(), _further(_further(own[:, 0]) ^ own[:, 1]))
    named = _further(_further(total))[cluster.ravel()]
    return pa.table({"key": named.view(np.int64), "fp": np.ascontiguousarray(both[:, 0, 0]), "fq": np.ascontiguousarray(both[:, 0, 1])})


CLUSTER = "key long, fp long, fq long"


def meetings(nodes: DataFrame, n: int, k: int, checked: int) -> DataFrame:
    """key, fp, fq: the clusters that links within one bucket of probes make."""

    def compare(table: pa.Table) -> pa.Table:
        out = _clusters(*_link(*(table[c].to_numpy() for c in ("fp", "fq", "key", "side")), k, checked))
        let_go()
        return out

    return _dealt(nodes, n, k).groupBy("bucket").applyInArrow(compare, CLUSTER)


class Rarest:
    """The order of shingles: first those that are not known as common, by their hashes, then
    the others by their number and hashes. ``times`` of each common one (ascending) are in one
    of ``share`` documents."""

    def __init__(self, common: np.ndarray, times: np.ndarray, share: int):
        self.common, self.times, self.share, self.tile = common, times, share, TILE

    def _times(self, own: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(own), np.int64)
        at = np.minimum(np.searchsorted(self.common, own), len(self.common) - 1)
        return np.where(self.common[at] == own, self.times[at], 0)

    def keys(self, own: np.ndarray, percent: int) -> np.ndarray:
        """The first elements of a set (ascending), of which it shares one with any set of that
        Jaccard similarity: these have ``percent`` of a hundred of its elements, at least."""
        many = len(own) + percent * len(own) // -100 + 1 if len(own) else 0
        take = many
        while True:  # most sets need not be looked at further than that
            times = self._times(own[:take])
            lack = many - int((times == 0).sum())
            if lack <= 0 or take == len(own):
                break
            take = min(len(own), take + 2 * lack)
        return own[np.argsort(times, kind="stable")[:many]]

    def tiles(self, keys: np.ndarray) -> np.ndarray:
        """Into how many tiles the rows of each key are cut."""
        return np.maximum(1, -(-self._times(keys) * self.share // self.tile))


def rarest(texts: DataFrame, width: int) -> Rarest:
    """Counts the shingles of about ``COUNTED`` different texts; the driver sees at most
    ``MOST_COMMON`` of them."""
    share = max(1, -(-texts.count() // COUNTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for begin, end in slices(offsets):
                sets = sets_of(raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], width)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    some = texts.select("text", F.xxhash64("text").alias("of")).filter(F.pmod("of", F.lit(share)) == 0).dropDuplicates(["of"])
    counted = some.select("text").mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON)
    found = counted.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    common, times = found["shingle"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(common)
    return Rarest(common[order], times[order], share)


def _entries(key: np.ndarray, tiles: np.ndarray, row: np.ndarray, fp: np.ndarray, fq: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """bucket and entries of the keys of some rows."""
    if tiles.max(initial=1) > 1:
        own = (_further(_further(fp.view(np.uint64)) ^ fq.view(np.uint64))[row] % tiles.astype(np.uint64)).astype(np.int64)
        every = np.repeat(np.arange(len(key)), tiles)
        other = np.arange(len(every)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        i, j = np.minimum(own[every], other).astype(np.uint64), np.maximum(own[every], other).astype(np.uint64)
        key, row = np.where(tiles[every] > 1, _further(key[every] ^ _further((i << np.uint64(32)) + j + np.uint64(1))), key[every]), row[every]
    entries = np.empty(len(key), ENTRY)
    entries["key"], entries["fp"], entries["fq"], entries["n"] = key, fp[row], fq[row], n[row]
    bucket = (_further(key) >> np.uint64(16)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    bucket = bucket[by]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    at = (np.append(first, len(bucket)) * ENTRY.itemsize).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(entries[by])])
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), values], names=["bucket", "entries"])


def _deal(order: Rarest, buckets: int):
    """The entries of sets, some rows at once, as one value for each bucket; an entry whose key
    is cut into tiles goes to every pair of tiles that its own is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.nbytes
            if not held or batch is not None and size < DEALT_BYTES:
                continue
            table, held, size = pa.Table.from_batches(held).combine_chunks(), [], 0
            raw, offsets = utf8(table["keys"].combine_chunks())
            key, row = np.frombuffer(raw.tobytes(), "<u8"), np.repeat(np.arange(len(table)), np.diff(offsets) // 8)
            fp, fq, n = (table[c].to_numpy() for c in ("fp", "fq", "n"))
            tiles = order.tiles(key)
            ends, begin = np.cumsum(tiles), 0
            while begin < len(key):  # copies of common keys some at a time, too
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + DEALT, "right")))
                yield _entries(key[begin:end], tiles[begin:end], row[begin:end], fp, fq, n, buckets)
                begin = end
        let_go()

    return run


def _link_sizes(fp: np.ndarray, fq: np.ndarray, size: np.ndarray, key: np.ndarray, k: int, checked: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a key that are linked and whose sizes allow the similarity, as spanning stars."""
    order = np.lexsort((fq, fp, size, key))
    same = lambda x: x[order][1:] == x[order][:-1]
    order = order[np.append(True, ~(same(key) & same(fp) & same(fq)))]
    again = same(key)
    order = order[np.append(again, False) | np.append(False, again)]  # most keys are of one set
    key = key[order]
    size, bits, more = size[order].astype(np.int64), fp[order].view(np.uint64), fq[order].view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(key))
    sizes = (ends - starts)[: len(starts)]
    us, vs = [], []

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        first, second = np.bitwise_count(bits[a] ^ bits[b]), np.bitwise_count(more[a] ^ more[b])
        return (first <= k) & (first + second <= checked) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))

    stop = np.repeat(ends[: len(starts)], sizes)
    at = np.flatnonzero(np.repeat(sizes <= 64, sizes))
    shift = 1
    while len(at):  # each row against the one ``shift`` places on, while that is not too large
        at = at[at + shift < stop[at]]
        at = at[percent * size[at + shift] <= 100 * size[at]]
        held = at[near(at, at + shift)]
        us.append(held)
        vs.append(held + shift)
        shift += 1
    for s, e in zip(starts, ends):
        left = np.arange(s, e) if e - s > 64 else np.zeros(0, np.int64)
        while len(left) > 1:  # what is reached from one row is not compared again
            reached, left = left[:1], left[1:]
            while len(reached) and len(left):
                some, reached = reached[:64], reached[64:]
                low, high = np.searchsorted(size[left], [-(-percent * size[some].min() // 100), 100 * size[some].max() // percent + 1])
                close = left[low:high]
                i, j = np.nonzero(np.bitwise_count(bits[some][:, None] ^ bits[close][None, :]) <= k)
                held = near(some[i], close[j])
                j, where = np.unique(j[held], return_index=True)
                us.append(some[i[held][where]])
                vs.append(close[j])
                reached = np.concatenate([reached, close[j]])
                left = np.delete(left, low + j)
    return _stars(bits, more, us, vs)


def meetings_by_shingles(rows: DataFrame, order: Rarest, k: int, checked: int, percent: int) -> DataFrame:
    """key, fp, fq: the clusters that links within one bucket of keys (of ``rows``, a written
    table) make. All sets that are linked and of that Jaccard similarity share a key."""
    total = rows.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0

    def compare(table: pa.Table) -> pa.Table:
        entries = np.frombuffer(utf8(table["entries"].combine_chunks())[0].tobytes(), ENTRY)
        out = _clusters(*_link_sizes(*(np.ascontiguousarray(entries[c]) for c in ("fp", "fq", "n", "key")), k, checked, percent))
        let_go()
        return out

    dealt = rows.filter("keys is not null").select("keys", "fp", "fq", "n").mapInArrow(_deal(order, pieces(total * ENTRY.itemsize, 8 << 20, 12)), "bucket long, entries binary")
    return dealt.groupBy("bucket").applyInArrow(compare, CLUSTER).distinct()


def _described(width: int, order: Rarest, percent: int):
    """doc_id, the 128-bit key and size of the set of shingles, its fingerprints, the row's hash,
    and the shingles under which the set meets others; of equal sets of a task one has these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for begin, end in slices(offsets):
                sets = sets_of(raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], width)
                names = [named_set(own) for own in sets]
                held = []
                for own, name in zip(sets, names):
                    held.append(None if name in seen or not len(own) else order.keys(own, percent).tobytes())
                    seen.add(name)
                keys = np.array(names, np.int64).reshape(-1, 2)
                prints = np.array([set_fingerprint(own) for own in sets], np.uint64).reshape(-1, 2).view(np.int64)
                points = pa.array([packed_point(own) for own in sets], pa.binary())
                own = [batch.column(i).slice(begin, end - begin) for i in (0, 2)]
                columns = [own[0], *(pa.array(np.ascontiguousarray(x[:, i])) for x in (keys, prints) for i in (0, 1)), pa.array(np.array([len(s) for s in sets], np.int64)), own[1], points, pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "fp", "fq", "n", "row_hash", "point", "keys"])
        let_go()

    return run


def similar_sets(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 17, checked: int = 32) -> tuple[DataFrame, DataFrame | None]:
    """Classes (a, b: the key of a set of word shingles, and its smallest doc_id as least), and
    edges (u, v) that connect whatever pairs of that Jaccard similarity connect.

    Fingerprints within the limits only say which sets meet: those of one cluster of one
    bucket of keys, so a chance pair joins no groups. Sets that meet are compared with all
    of their shingles, and only the pairs that pass are edges. Texts do not
    move: a bitmap of bounded size says which rows' sets are wanted."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text", "doc_id").alias("row_hash"))
    order = rarest(texts, width)
    rows = checkpoint(texts.mapInArrow(_described(width, order, percent), "doc_id long, a long, b long, fp long, fq long, n long, row_hash long, point binary, keys binary"))
    classes = checkpoint(rows.groupBy("a", "b", "fp", "fq", "n").agg(F.min("doc_id").alias("least")))
    filled = classes.filter("n > 0").withColumn("sid", sid())
    if filled.isEmpty():
        return classes, None
    found = meetings_by_shingles(rows, order, k, checked, percent)
    alike = filled.groupBy("fp", "fq").agg(F.count("*").alias("sets")).filter("sets > 1").select(F.xxhash64("fp", "fq").bitwiseAND(F.lit(~3).cast("long")).alias("key"), "fp", "fq")
    held = checkpoint(found.unionByName(alike).join(filled.select("fp", "fq", "sid", "n"), ["fp", "fq"]).groupBy("key", "sid").agg(F.min("n").alias("n")))
    known = Known(known_points(rows, held), texts, width)
    edges = None
    first = F.col("key").bitwiseAND(F.lit(3).cast("long")) == 0
    for some in (first, ~first):  # what the first quarter links need not meet again
        edges = met(held.filter(some), edges, known, percent)
    return classes, edges


def keep_one(docs: DataFrame, width: int = 5, k: int = 17, checked: int | None = 32, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of the documents that pairs of a Jaccard
    similarity of ``percent`` connect, the one with the smallest id stays; without ``checked``,
    of those that fingerprints alone connect. A doc_id names one document; where rows repeat
    an id and a text, one of them stays. Only the texts of rows that may go are moved."""
    if checked is None:
        first = near_duplicates(docs, width, k).select(F.col("component_id").alias("id"))
    else:
        classes, edges = similar_sets(docs, width, percent, k, checked)
        if edges is None:
            first = classes.select(F.col("least").alias("id"))
        else:
            joined = components(edges)
            rooted = classes.join(joined, F.struct("a", "b") == joined.node, "left").select(F.coalesce("root", F.struct("a", "b")).alias("root"), "least")
            first = rooted.groupBy("root").agg(F.min("least").alias("id")).select("id")
    first = checkpoint(first.distinct())
    ids = docs.select("doc_id").distinct()
    gone = checkpoint(ids.join(first, ids.doc_id.eqNullSafe(first.id), "left_anti").select(F.xxhash64(F.col("doc_id").cast("long")).alias("name")))
    may_go = docs.withColumn("may_go_", sieve(gone, "name", gone.count()).lets(F.xxhash64(F.col("doc_id").cast("long"))))
    asked = may_go.filter("may_go_")
    kept = may_go.filter("not may_go_").unionByName(asked.join(first, asked.doc_id.eqNullSafe(first.id), "left_semi")).drop("may_go_")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = kept.withColumn("text_key_", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key_"]).drop("text_key_")
    return kept


def near_duplicates(docs: DataFrame, width: int = 4, k: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row."""
    found = checkpoint(fingerprints(docs, width))
    nodes = checkpoint(found.groupBy("fp", "fq").agg(F.min("doc_id").alias("least")))
    n = nodes.count()
    if n:
        joined = components(links(nodes, n, k))
        node = F.struct("fp", "fq")
        roots = nodes.withColumn("own", node).join(joined, F.col("own") == joined.node, "left").select("fp", "fq", "least", F.coalesce("root", "own").alias("root"))
        named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
        nodes = join_counted(roots, named, ["root"]).select("fp", "fq", "component_id")
    else:
        nodes = nodes.select("fp", "fq", F.col("least").alias("component_id"))
    return found.join(nodes, ["fp", "fq"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
