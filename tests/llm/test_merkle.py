"""Operator 11 against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank int, node string, tree string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "n", "t") for r in rows], SCHEMA).repartition(3)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fan=2):
    """Root, and for each leaf the siblings left and right of it, level by level."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // fan * fan : a // fan * fan + fan]
            ways[i].append(("".join(run[: a % fan]), "".join(run[a % fan + 1 :])))
        level = [H(*level[i : i + fan]) for i in range(0, len(level), fan)]
        at = [a // fan for a in at]
    return level[0], ways


def brute(rows, fan=2):
    made = lambda r, more=0: H(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, made(r)))
        trees[name] = own, *tree([made(r) for r in own], fan)
    root, upper = tree([trees[name][1] for name in names], fan) if names else (None, [])
    out = []
    for name, above in zip(names, upper):
        own, subroot, ways = trees[name]
        for r, way in zip(own, ways):
            way = way + above
            folded = made(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, right in way:
                folded = H(left, folded, right)
            out.append((r[0], made(r), subroot, root, H(*(s for step in way for s in step)), folded, folded == root))
    return sorted(out, key=str)


def documents(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = rnd.choice(["", "größe\n été", "word " * rnd.randint(1, 30), None, "🙂"])
        rows.append((i, text, rnd.choice(["en", "en", "en", "de", "été", "", None, "zz"]), rnd.choice(["s", None, ""]), rnd.choice([0, None, 5, 2**62])))
    return rows + [rows[3], rows[3], (3, "another", rows[3][2], "s", 1), (None, "a", "en", None, 2), (None, None, None, None, None), (None, None, None, None, None), (n, "x" * 1_200_000, "long", "s", 7)]


@pytest.mark.parametrize("n, fan, digits", [(120, 2, 2), (60, 3, 1), (40, 2, 8)])
def test_equals_brute_force(spark, n, fan, digits):
    rows = documents(n, n)
    got = merkle.manifest(frame(spark, rows), fan, digits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, fan)


def test_one_row_one_tree_and_none(spark):
    for rows in ([(7, "a", "en", "s", 1)], [(i, "a", "en", "s", i) for i in range(5)], [(i, "b", f"l{i}", "s", i) for i in range(5)], []):
        assert sorted(map(tuple, merkle.manifest(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_ranges_of_equal_rows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 16)
    rows = [(1, "same", "en", "s", 4)] * 300 + documents(30)
    got = merkle.manifest(frame(spark, rows), 2, 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_text_moves_and_groupings_need_one_shuffle(spark):
    nodes = frame(spark, documents(20)).select(F.col("lang").alias("tree"), "doc_id", F.lit(30).cast("long").alias("n")).select("tree", F.col("doc_id").alias("rank"), "n", F.struct(F.lit("h").alias("h")).alias("node"))
    plan = merkle._blocks(nodes, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
