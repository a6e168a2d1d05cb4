"""Operator 12: n-gram Jaccard join by points of group counts.

A document's set of word shingles is hashed into groups. Two sets of a Jaccard similarity of
``percent`` differ in few elements (a ninth of the smaller, at 90), so of one group more than
that, some group is the same in both. Sets of about a size are cut into as many groups, and
a few spare ones, and meet where they hold the same: a meeting is named by the size class,
the group and the hash of what is in it. Groups of less than ``LIGHT`` elements name no
meeting, unless a set has more of them than there are spare ones.

Within a meeting every set is a point of group counts in an R-tree that is loaded in bulk;
larger sets have more groups, which are added up where they meet a smaller one's. The overlap of two sets is at most the sum of the smaller counts, coordinate by
coordinate, so a box whose upper corner does not reach the overlap that is asked for is left
out with all its points. Points meet first; only the sets whose point has another one in
reach are then fetched and compared element by element. Links are kept as a spanning star,
and what is linked already is not compared again, so a large group of near copies costs
about as much as it has members.

Meetings are held in three rounds of ever more groups, and no two sets meet for what they share
in a later one. After each the sets that are known to
be linked share a label, and a meeting that only one label is left in, or whose members have
met under another name, is not held. A meeting of more than ``TILE_BYTES`` is cut into tiles:
each meets by itself, then one set of every label meets the others of its kind, then what is
outside the largest label meets all.

Texts never move: they are read once for keys and points, and once in each round for the sets
of those whose points are in reach, which a bitmap of bounded size picks out.

Defined results: null and empty texts and those without words have an empty set, and are
linked with nothing, not even each other. Fewer words than a shingle has are one shingle.
Equal sets are one node. Rows of a null doc_id take part, but do not name a component unless
all its ids are null. Repeated rows share a component. An empty table gives no rows. Other
columns are ignored. Shingles are compared by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Sieve, checkpoint, join_hubs, let_go, pieces, sieve, slices, utf8
from millrace.llm.components import components, local_roots
from millrace.llm.paragraphs import _LOWER, _MIX, _mixed, _word_hashes, word_starts

WIDTH, PERCENT = 3, 90
#: Fewest and most coordinates of a point, elements for each; points of a leaf and boxes of a node of the tree.
GROUPS, MOST_GROUPS, EACH = 64, 1 << 16, 4
LEAF, FAN = 32, 16
#: Fewer elements of a group name no meeting where it can be helped.
LIGHT = 3
#: Groups of the first and of the second round; the third has the rest.
ROUNDS = (2, 8)
TILE_BYTES = 8 << 20


def sets_of(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text the hashes of its distinct word shingles, ascending."""
    raw = _LOWER[raw]
    at, text = word_starts(raw, offsets)
    none = np.zeros(0, np.uint64)
    if not len(at):
        return [none] * (len(offsets) - 1)
    words = _word_hashes(raw, at)
    run = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        run = _mixed(run * _MIX + words[i : i + len(run)])
    first = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            few = np.full(1, b - a, np.uint64)
            for word in words[a:b]:
                few = _mixed(few * _MIX + word)
            out.append(few)
        else:
            out.append(none)
    return out


class Cuts:
    """Into how many groups the sets of a size class are cut. Sets of class c have at most
    ``top[c]`` elements, so similar ones of it, or one of it and one below, differ in at most
    ``apart(top[c])``; one group more than that, and the spare ones, are cut."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 99:
            raise ValueError("percent must be from 1 to 99")
        self.percent = percent
        self.top, self.starts, self.spare = [percent // (100 - percent) - (percent % (100 - percent) == 0)], [None], [0]

    def apart(self, size: int) -> int:
        """Most elements in which a set of this size and a similar one that is no smaller differ."""
        return size * (100 - self.percent) // self.percent

    def _grow(self, size: int) -> None:
        while self.top[-1] < size:
            top = max(self.top[-1] * 3 // 2, self.top[-1] * 100 // self.percent) + 1
            apart = self.apart(top)
            spare = min(4, apart // 3) + apart // 32
            n = apart + 1 + spare
            self.top.append(top)
            self.spare.append(spare)
            self.starts.append(np.array([(i << 64) // n for i in range(n)], np.uint64))

    def classes(self, size: int) -> list[int]:
        """The class of a set and, if sets of the next one can be similar, that one; none for
        sets that only equal ones are similar to."""
        if size <= self.top[0]:
            return []
        larger = size * 100 // self.percent
        self._grow(larger + 1)
        own = int(np.searchsorted(self.top, size))
        return [own, own + 1] if larger > self.top[own] else [own]

    def keys(self, own: np.ndarray) -> np.ndarray:
        """The meetings of a set; their two lowest bits are the round."""
        out = []
        total = None
        for c in self.classes(len(own)):
            if total is None:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(own), dtype=np.uint64)])
            at = np.append(np.searchsorted(own, self.starts[c]), len(own))
            group = np.arange(len(at) - 1)
            light = np.diff(at) < LIGHT
            if light.sum() <= self.spare[c]:
                group = group[~light]
            held = total[at[group + 1]] - total[at[group]]
            named = _mixed(held * _MIX + _mixed((group + (c << 40)).astype(np.uint64)))
            number = np.searchsorted(ROUNDS, group, "right").astype(np.uint64)
            out.append(named & ~np.uint64(3) | number)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def named_set(own: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8").tolist())


def _described(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, seen = Cuts(percent), set()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for begin, end in slices(offsets):
                sets = sets_of(raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], width)
                names = [named_set(own) for own in sets]
                keys = []
                for own, name in zip(sets, names):  # of equal sets of a task one has keys
                    keys.append(np.zeros(0, np.uint64) if name in seen else cuts.keys(own))
                    seen.add(name)
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                both = np.array(names, np.int64).reshape(-1, 2)
                columns = [batch.column(0).slice(begin, end - begin), *(pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)), pa.array(np.array([len(s) for s in sets], np.int64)), batch.column(2).slice(begin, end - begin)]
                points = pa.array([packed_point(own) if len(k) else None for own, k in zip(sets, keys)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, points, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys).view(np.int64)))], names=["doc_id", "a", "b", "n", "row_hash", "point", "keys"])
        let_go()

    return run


def kept_sets(texts: DataFrame, width: int, wanted: Sieve) -> DataFrame:
    """sid, a, b and shingles of the rows (text, row_hash) that the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:  # sifted here, as one more worker would take more memory than its texts
            batch = batch.filter(pa.array(wanted.has(batch.column(1).to_numpy())))
            raw, offsets = utf8(batch.column(0))
            for begin, end in slices(offsets):
                sets = sets_of(raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], width)
                rows = []
                for own in sets:
                    if (name := named_set(own)) not in seen:
                        seen.add(name)
                        rows.append((*name, own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["a", "b", "shingles"])
        let_go()

    found = texts.select("text", "row_hash").mapInArrow(run, "a long, b long, shingles binary")
    return found.select(sid().alias("sid"), "a", "b", "shingles")


def _kept_keys(wanted: Sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, each = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            kept = wanted.has(flat)
            row = np.repeat(np.arange(len(each)), each)[kept]
            yield pa.RecordBatch.from_arrays([pa.array(flat[kept]), *(batch.column(i).take(pa.array(row)) for i in (1, 2))], names=["key", "sid", "n"])

    return run


def point_of(own: np.ndarray) -> np.ndarray:
    groups = GROUPS
    while groups < min(MOST_GROUPS, len(own) // EACH):
        groups *= 2
    return np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint32)


def packed_point(own: np.ndarray) -> bytes:
    """A point's counts as bytes; the first says how many each count takes."""
    point = point_of(own)
    each = 1 if point.max(initial=0) < 256 else 4
    return bytes([each]) + point.astype(f"<u{each}").tobytes()


def together(points: list[bytes]) -> np.ndarray:
    """Points as rows of as many groups as the shortest has; further ones are added up."""
    rows = [np.frombuffer(p, f"<u{p[0]}", offset=1) for p in points]
    groups = min(map(len, rows))
    return np.stack([row.reshape(-1, groups).sum(axis=0, dtype=np.int32) for row in rows])


class CountTree:
    """An R-tree over points of counts, loaded in bulk: points are split at the median of the
    widest coordinate down to leaves. A box is its upper corner, and its sets' least and most
    elements, as the overlap with whatever it holds is bounded by these."""

    def __init__(self, points: np.ndarray, size: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.concatenate(list(self._leaves(points))) if len(points) else np.zeros(0, np.int64)
        upper, least, most = points[self.order], size[self.order], size[self.order]
        self.levels, fan = [(upper, least, most)], LEAF
        while len(upper) > 1:
            at = np.arange(0, len(upper), fan)
            upper, least, most = np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((upper, least, most))
            fan = FAN

    @staticmethod
    def _leaves(points: np.ndarray) -> Iterator[np.ndarray]:
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                yield rows
                continue
            own = points[rows]
            widest = int((own.max(axis=0) - own.min(axis=0)).argmax())
            half = -(-len(rows) // 2 // LEAF) * LEAF  # all leaves but the last are full
            rows = rows[np.argpartition(own[:, widest], half)]
            stack += [rows[half:], rows[:half]]

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """The points whose sets may be similar to one of this point and size."""
        at, p = np.zeros(min(1, len(self.levels[-1][0])), np.int64), self.percent
        for level in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[level]
            bound = np.minimum(upper[at], point).sum(axis=1)
            at = at[((100 + p) * bound >= p * (size + least[at])) & (100 * most[at] >= p * size) & (100 * size >= p * least[at])]
            if level:
                fan = FAN if level > 1 else LEAF
                at = (at[:, None] * fan + np.arange(fan)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]


def linked(sets: list[np.ndarray], points: np.ndarray, size: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels that connect whatever similar sets and labels connect."""
    out: list[tuple[int, int]] = []
    _, label = np.unique(label, return_inverse=True)
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
    unseen = np.ones(len(sets), bool)
    rows, tree = np.arange(len(sets)), CountTree(points, size, percent)
    for group in members:
        if not unseen[group[0]]:
            continue
        unseen[group] = False
        reached = list(group)
        while reached:
            if 2 * unseen[rows].sum() < len(rows):  # what was reached is not looked for again
                rows = rows[unseen[rows]]
                tree = CountTree(points[rows], size[rows], percent)
            if not len(rows):
                break
            one = reached.pop()
            close = rows[tree.near(points[one], size[one])]
            close = close[unseen[close]]
            if not len(close):
                continue
            flat = np.concatenate([sets[i] for i in close])
            at = np.searchsorted(sets[one], flat)
            same = sets[one][np.minimum(at, len(sets[one]) - 1)] == flat
            both = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(size[close])[:-1]]))
            close = close[(100 + percent) * both >= percent * (size[close] + size[one])]
            for i in close:
                if unseen[i]:
                    out.append((int(one), int(i)))
                    unseen[members[label[i]]] = False
                    reached += list(members[label[i]])
    return out


NODE = "struct<a: long, b: long>"


def _linked_here(percent: int):
    def run(table: pa.Table) -> pa.Table:
        key, a, b, label = (table[c].to_numpy() for c in ("key", "a", "b", "label"))
        order = np.lexsort((b, a, key))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        order = order[new]  # rows of one set and meeting
        raw, offsets = utf8(table["shingles"].take(pa.array(order)).combine_chunks())
        flat, size, at = np.frombuffer(raw.tobytes(), np.uint64), np.diff(offsets) // 8, offsets // 8
        points = table["point"].take(pa.array(order)).to_pylist()
        key, a, b, label = key[order], a[order], b[order], label[order]
        ends = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        out: list[tuple[int, int]] = []
        for s, e in zip(ends[:-1], ends[1:]):
            if e - s > 1:
                out += [(s + i, s + j) for i, j in linked([flat[at[r] : at[r + 1]] for r in range(s, e)], together(points[s:e]), size[s:e], label[s:e], percent)]
        nodes, node = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
        node = node.ravel()
        u, v = np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)
        root = local_roots(len(nodes), node[u], node[v])
        kept = np.flatnonzero(root != np.arange(len(nodes)))
        pick = lambda rows: pa.StructArray.from_arrays([pa.array(nodes[rows, 0]), pa.array(nodes[rows, 1])], names=["a", "b"])
        let_go()
        return pa.table({"u": pick(kept), "v": pick(root[kept])})

    return run


def sid(a: str = "a", b: str = "b") -> Column:
    """A set's name as one number; two sets of one number would only meet more others."""
    return F.xxhash64(a, b)


def _in_reach(percent: int):
    """The rows of each key whose point has one in reach that has another label, and that it
    has not met before."""

    def run(table: pa.Table) -> pa.Table:
        key, label, size = (table[c].to_numpy() for c in ("key", "label", "n"))
        order = np.argsort(key, kind="stable")
        every = table["point"].to_pylist()
        before = [frozenset(x or ()) for x in table["before"].to_pylist()]
        ends = np.append(np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])), len(order))
        kept: list[int] = []
        for s, e in zip(ends[:-1], ends[1:]):
            rows = order[s:e]
            if e - s > 1:
                points = together([every[r] for r in rows])
                tree = CountTree(points, size[rows], percent) if e - s > 2 else None
                for i, r in enumerate(rows):
                    near = rows[tree.near(points[i], size[r])] if tree else rows[[1 - i]] if _reaches(points, size[rows], percent) else rows[:0]
                    near = near[label[near] != label[r]]
                    if any(before[r].isdisjoint(before[other]) for other in near):
                        kept.append(r)
        let_go()
        return table.select(["key", "sid", "label", "n"]).take(pa.array(kept, pa.int64()))

    return run


def _reaches(two: np.ndarray, size: np.ndarray, percent: int) -> bool:
    return (100 + percent) * int(np.minimum(two[0], two[1]).sum()) >= percent * int(size.sum())


class Known:
    """What is known of sets: their points (sid, a, b, n, one: the hash of a row that has it, and
    point), a written table, and the texts (text, row_hash) that the sets are cut from anew."""

    def __init__(self, points: DataFrame, texts: DataFrame, width: int):
        self.points, self.texts, self.width = points, texts, width

    def sets(self, some: DataFrame) -> DataFrame:
        """sid, a, b, point and shingles of the sets that the rows name, and few others."""
        wanted = checkpoint(self.points.join(some.select("sid").distinct(), "sid", "left_semi").select("one"))
        found = kept_sets(self.texts, self.width, sieve(wanted, "one", wanted.count()))
        return found.join(self.points.select("a", "b", "point"), ["a", "b"])


def _meet(rows: DataFrame, known: Known, percent: int, before: DataFrame | None) -> DataFrame:
    """Links of the sets (sid, label, n) that share a key."""
    bytes_ = lambda each: lambda of: of.agg(F.sum(each)).first()[0] or 0
    points, sets = bytes_(F.greatest(F.lit(GROUPS), F.col("n") / 2) + 40), bytes_(8 * F.col("n"))
    part = lambda size: F.pmod("key", F.lit(pieces(size, TILE_BYTES, 12))).alias("part")
    own = known.points.select("sid", "point")
    own = own.withColumn("before", F.lit(None).cast("array<long>")) if before is None else own.join(before, "sid", "left")
    held = rows.join(own, "sid").select(part(points(rows)), "key", "sid", "label", "n", "point", "before")
    near = checkpoint(held.groupBy("part").applyInArrow(_in_reach(percent), "key long, sid long, label long, n long"))
    if near.isEmpty():  # no text is read
        return rows.sparkSession.createDataFrame([], f"u {NODE}, v {NODE}")
    held = near.join(known.sets(near), "sid").select(part(sets(near)), "key", "a", "b", "label", "point", "shingles")
    return held.groupBy("part").applyInArrow(_linked_here(percent), f"u {NODE}, v {NODE}")


def _labelled(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """rows with label: equal ones are linked."""
    if edges is None:
        return rows.withColumn("label", F.col("sid"))
    first = edges.groupBy(sid("u.a", "u.b").alias("sid")).agg(F.min(sid("v.a", "v.b")).alias("label"))
    first = checkpoint(first)
    further = first.join(first.select(F.col("sid").alias("label"), F.col("label").alias("next")), "label", "left").select("sid", F.coalesce("next", "label").alias("label"))
    return rows.join(further, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _tile(of: str) -> Column:
    return F.pmod(F.xxhash64("sid", F.lit(5)), F.col(of)).cast("int")


def _tiles(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / TILE_BYTES)).cast("int")


def _pairs_of_tiles(rows: DataFrame, tiles: str) -> DataFrame:
    """Each row once for each pair of tiles that its own is in."""
    own = _tile(tiles)
    cells = F.transform(F.sequence(F.lit(0), F.col(tiles) - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    return rows.select("key", "sid", "label", "n", F.explode(cells).alias("cell")).select(F.xxhash64("key", "cell.i", "cell.j").alias("key"), "sid", "label", "n")


def met(held: DataFrame, edges: DataFrame | None, known: Known, percent: int, before: DataFrame | None = None) -> DataFrame | None:
    """edges (u, v) with those that the meetings (key, sid, n) of a round add, so that they
    connect whatever similar sets of one meeting connect. ``before`` (sid, before) has the keys
    under which sets have met in earlier rounds, which need not meet again."""
    rows = checkpoint(_labelled(held, edges))
    found = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("sid")).alias("who"), F.count("*").alias("many"), F.sum(8 * F.col("n")).alias("size"))
    once = checkpoint(found.filter("low < high").groupBy("who", "many", "size").agg(F.min("key").alias("key")).select("key", "many", "size", _tiles(F.col("size")).alias("tiles")))
    if once.isEmpty():
        return edges
    rows = checkpoint(join_hubs(rows, once.select("key", "many", "tiles"), ["key"], "many"))
    more = lambda new: checkpoint(new if edges is None else edges.unionByName(new))
    edges = more(_meet(rows.select(F.xxhash64("key", _tile("tiles")).alias("key"), "sid", "label", "n"), known, percent, before))
    large = rows.filter("tiles > 1").select("key", "sid", "n", "many")
    if large.isEmpty():
        return edges
    large = checkpoint(large)
    again = checkpoint(_labelled(large, edges))
    one_each = again.groupBy("key", "label").agg(F.min(F.struct("sid", "n")).alias("one")).select("key", "one.sid", "one.n", "label")
    sizes = one_each.groupBy("key").agg(F.sum(8 * F.col("n")).alias("size"), F.count("*").alias("few")).select("key", "few", _tiles(F.col("size")).alias("tiles"))
    edges = more(_meet(_pairs_of_tiles(join_hubs(one_each, checkpoint(sizes), ["key"], "few"), "tiles"), known, percent, before))
    again = checkpoint(_labelled(large, edges))
    sizes = again.groupBy("key", "label").agg(F.sum(8 * F.col("n")).alias("size"))
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("most"), F.max("size").alias("core"), F.sum("size").alias("all"))
    most = checkpoint(most.filter("all > core").select("key", "most", _tiles(F.col("core")).alias("inner"), _tiles(F.col("all") - F.col("core")).alias("outer")))
    again = checkpoint(join_hubs(again.drop("many"), most.join(large.groupBy("key").agg(F.first("many").alias("many")), "key"), ["key"], "many"))
    rest, core = again.filter("label <> most"), again.filter("label = most")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    cell = F.xxhash64("key", "i", "j", F.lit("core")).alias("key")
    across = rest.select("key", "sid", "label", "n", _tile("outer").alias("i"), each("inner").alias("j")).unionByName(core.select("key", "sid", "label", "n", each("outer").alias("i"), _tile("inner").alias("j")))
    return more(_meet(across.select(cell, "sid", "label", "n").unionByName(_pairs_of_tiles(rest, "outer")), known, percent, before))


def similar_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, a, b, n), classes (a, b, least doc_id, many) of the sets that are not
    empty, and edges (u, v) that connect whatever similar sets connect."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text", "doc_id").alias("row_hash"))
    rows = checkpoint(texts.mapInArrow(_described(width, percent), "doc_id long, a long, b long, n long, row_hash long, point binary, keys array<long>"))
    classes = checkpoint(rows.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")))
    meetings = rows.select(F.explode("keys").alias("key"), sid().alias("sid")).groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
    keys = checkpoint(meetings.filter("low < high").select("key"))
    some = keys.count()
    if not some:
        return rows, classes, None
    held = rows.filter(F.size("keys") > 0).select("keys", sid().alias("sid"), "n").mapInArrow(_kept_keys(sieve(keys, "key", some)), "key long, sid long, n long")
    held = checkpoint(held.groupBy("key", "sid").agg(F.min("n").alias("n")))
    known = Known(known_points(rows, held), texts, width)
    edges = None
    number_of = F.col("key").bitwiseAND(F.lit(3).cast("long"))
    for number in range(len(ROUNDS) + 1):  # the rounds before the last have few groups
        before = checkpoint(held.filter(number_of < number).groupBy("sid").agg(F.collect_list("key").alias("before"))) if number else None
        edges = met(held.filter(number_of == number), edges, known, percent, before)
    return rows, classes, edges


def known_points(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The points (of ``rows``) of the sets that meet others, each once."""
    own = rows.filter("point is not null").select(sid().alias("sid"), "a", "b", "n", F.col("row_hash").alias("one"), "point")
    return checkpoint(own.join(held.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["a", "b"]))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (distinct) and component_id (smallest doc_id that links reach) of each row."""
    rows, classes, edges = similar_sets(docs, width, percent)
    if edges is not None:
        joined = components(edges)
        named = classes.join(joined, F.struct("a", "b") == joined.node, "left").withColumn("root", F.coalesce("root", F.struct("a", "b")))
        named = checkpoint(named.select("a", "b", "least", "many", "root"))
        least = checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")))
        classes = checkpoint(join_hubs(named, least, ["root"], "sets").select("a", "b", "many", "component_id"))
    else:
        classes = classes.select("a", "b", "many", F.col("least").alias("component_id"))
    some, none = rows.filter("n > 0").select("doc_id", "a", "b", "n"), rows.filter("n = 0")
    found = join_hubs(some, classes, ["a", "b"], "many").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
