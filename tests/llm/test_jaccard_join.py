"""Operator 12 against sets of strings compared pair by pair."""

import random
import re

import numpy as np
import pytest

from millrace.llm import jaccard_join
from millrace.llm.common import Sieve, _sieved, join_hubs, sieve

SCHEMA = "doc_id long, text string, n long, label string, key long, a int, component_id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=3, percent=90):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    return sorted(((doc, len(s), names.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        at = rnd.randrange(len(words))
        words[at : at + rnd.choice([0, 1])] = [f"Ne{rnd.randint(0, 10**6)}"] * rnd.choice([0, 1, 1])
    return words


def documents(seed, groups=12, each=9, common=6):
    rnd = random.Random(seed)
    bank = [f"w{i}" for i in range(300)] + ["größe", "été", "A", "a"]
    stock = [" ".join(rnd.choices(bank, k=9)) for _ in range(common)]
    rows = []
    for g in range(groups):
        base = rnd.choices(bank, k=rnd.choice([4, 9, 12, 20, 40, 90, 300]))
        for _ in range(each):
            words = edited(rnd, base, rnd.randint(0, max(1, len(base) // 20)))
            text = rnd.choice([" ", "\n", "\t "]).join(words)
            rows.append(text + " " + rnd.choice(stock) if rnd.random() < 0.2 else text)
    rows += stock + [rows[0], rows[0].upper().replace("Ö", "ö").replace("ß", "ß"), "one", "one two", "ONE  two", "", "  \n", None, None, ""]
    numbered = [(7 * i % 1009, t) for i, t in enumerate(rows)]
    return numbered + [(numbered[3][0], "another text of this id with some more words in it"), numbered[5], numbered[5], (None, rows[7]), (None, "only a null id has this text"), (None, "only a null id has this text")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = documents(seed)
    got = jaccard_join.join(frame(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_other_widths_and_similarities(spark):
    rows = documents(5, 8, 7)
    for width, percent in ((2, 70), (5, 55)):
        assert sorted(map(tuple, jaccard_join.join(frame(spark, rows), width, percent).collect()), key=str) == brute(rows, width, percent)


def test_large_meetings_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 4000)
    rows = documents(8, 3, 40)
    assert sorted(map(tuple, jaccard_join.join(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_empty_table_and_a_long_text(spark):
    assert jaccard_join.join(frame(spark, [])).count() == 0
    words = [f"x{i % 70001}" for i in range(160_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(random.Random(1), words, 900))), (3, "x1 x2"), (4, "x1 x2 x3")]
    assert sorted(map(tuple, jaccard_join.join(frame(spark, rows)).collect())) == brute(rows)


def test_groups_hold_what_similar_sets_share():
    rng, cuts = np.random.default_rng(3), jaccard_join.Cuts(90)
    for size in [*range(1, 60), 150, 1000, 9000]:
        for _ in range(4):
            one = np.unique(rng.integers(1 << 63, size=size).astype(np.uint64) * np.uint64(2))
            apart = cuts.apart(len(one))
            gone = rng.integers(0, apart + 1)
            two = np.unique(np.concatenate([np.delete(one, rng.permutation(len(one))[:gone]), rng.integers(1 << 63, size=apart - gone).astype(np.uint64)]))
            both = len(np.intersect1d(one, two))
            if 190 * both >= 90 * (len(one) + len(two)) and not np.array_equal(one, two):
                assert np.intersect1d(cuts.keys(one), cuts.keys(two)).size


def test_the_tree_leaves_out_nothing_that_is_similar():
    rng = np.random.default_rng(4)
    points = rng.poisson(3, size=(700, jaccard_join.GROUPS)).astype(np.int32)
    points[300:500] = points[7] + rng.integers(0, 2, size=(200, jaccard_join.GROUPS))
    size = points.sum(axis=1)
    tree = jaccard_join.CountTree(points, size, 90)
    for q in range(0, 700, 13):
        bound = np.minimum(points, points[q]).sum(axis=1)
        wanted = np.flatnonzero((190 * bound >= 90 * (size + size[q])) & (10 * size >= 9 * size[q]) & (10 * size[q] >= 9 * size))
        assert np.array_equal(np.sort(tree.near(points[q], size[q])), wanted)


def test_points_of_larger_sets_have_more_groups_and_add_up():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(1 << 63, size=n).astype(np.uint64)) for n in (70, 3000, 90_000)]
    points = [jaccard_join.point_of(s) for s in sets]
    assert [len(p) for p in points] == [64, 1024, 32768] and [p.sum() for p in points] == [len(s) for s in sets]
    met = jaccard_join.together([jaccard_join.packed_point(s) for s in sets])
    assert met.shape == (3, 64) and all((row == np.bincount((s & np.uint64(63)).astype(int), minlength=64)).all() for row, s in zip(met, sets))


def test_sieve_and_hubs(spark):
    names = spark.range(5000).selectExpr("xxhash64(id) as name", "id")
    made = sieve(names, "name", 5000)
    every = np.array([r[0] for r in names.select("name").collect()])
    assert made.has(every).all()
    other = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    assert made.has(other).mean() < 0.05
    assert Sieve(np.zeros(16, np.uint64)).has(other).sum() == 0 and _sieved(other.view(np.uint64), 1, 1024).max() < 1024
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(k, k) for k in range(2, 40)] + [(None, 5)], "k int, v int")
    few = rows.groupBy("k").count().withColumn("other", rows.k * 2)
    assert sorted(map(tuple, join_hubs(rows, few, ["k"], "count", 3).collect())) == sorted(map(tuple, rows.join(few, "k").collect()))
