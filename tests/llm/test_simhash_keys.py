"""The pipeline's SimHash stage deals fingerprints by rare shingles: what must meet meets, what need not does not."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import utf8
from millrace.llm.components import local_roots
from millrace.llm.jaccard_join import sets_of

SCHEMA = "doc_id long, text string"


def order_of(sets, share=1):
    x, times = np.unique(np.concatenate(sets), return_counts=True)
    return simhash.Rarest(x[times >= simhash.COMMON], times[times >= simhash.COMMON], share)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_similar_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    stock = rng.integers(1 << 63, size=60, dtype=np.uint64)  # some sets are made of common elements alone
    sets = []
    for _ in range(60):
        base = np.unique(np.concatenate([rng.integers(1 << 63, size=rng.integers(0, 80), dtype=np.uint64), rng.choice(stock, rng.integers(1, 60))]))
        for _ in range(4):
            kept = rng.random(len(base)) >= rng.choice([0, 0.02, 0.1, 0.2])
            sets.append(np.union1d(base[kept] if kept.any() else base, rng.choice(stock, rng.integers(0, 4))))
    close = 0
    for order in (order_of(sets), simhash.Rarest(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)):
        keys = [set(order.keys(s, percent).tolist()) for s in sets]
        assert all(len(k) == len(s) - -(-percent * len(s) // 100) + 1 for k, s in zip(keys, sets))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if both * 100 >= percent * (len(a) + len(sets[j]) - both):
                    close += 1
                    assert keys[i] & keys[j]
    assert close > 50
    assert not len(order.keys(np.zeros(0, np.uint64), percent))


@pytest.mark.parametrize("tile", [1 << 15, 7])
@pytest.mark.parametrize("each", [3, 90])
def test_deal_and_link_against_brute_force(monkeypatch, tile, each):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng, k, checked, percent = np.random.default_rng(each), 17, 32, 80
    sets, prints = [], []
    for _ in range(360 // each):
        base, bits = rng.integers(1 << 63, size=40, dtype=np.uint64), rng.integers(1 << 63, size=2, dtype=np.uint64)
        for _ in range(each):
            flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2, rng.integers(1, 14))).astype(np.uint64), axis=1)
            sets.append(np.unique(base[rng.random(40) >= rng.choice([0, 0.05, 0.1])]))
            prints.append(bits ^ flips)
    prints = np.array(prints).view(np.int64)
    n = np.array([len(s) for s in sets])
    order = order_of(sets)
    batch = pa.RecordBatch.from_arrays([pa.array([order.keys(s, percent).tobytes() for s in sets], pa.binary()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array(n)], names=["keys", "fp", "fq", "n"])
    dealt = pa.Table.from_batches([*simhash._deal(order, 5)(iter([batch.slice(0, 100), batch.slice(100)])), *simhash._deal(order, 5)(iter([batch.slice(50, 60)]))])  # some of them twice
    clusters = []
    for bucket in np.unique(dealt["bucket"]):
        table = dealt.filter(pa.array(dealt["bucket"].to_numpy() == bucket))
        entries = np.frombuffer(utf8(table["entries"].combine_chunks())[0].tobytes(), simhash.ENTRY)
        clusters.append(simhash._clusters(*simhash._link_sizes(*(np.ascontiguousarray(entries[c]) for c in ("fp", "fq", "n", "key")), k, checked, percent)))
    held = {}
    for key, fp, fq in zip(*(pa.concat_tables(clusters)[c].to_pylist() for c in ("key", "fp", "fq"))):
        held.setdefault((fp, fq), set()).add(key)
    own = [held.get(tuple(p), set()) for p in prints.tolist()]
    bits = prints.view(np.uint64)  # of signed numbers numpy counts the absolute value's
    first, second = (np.bitwise_count(bits[:, None, i] ^ bits[None, :, i]) for i in (0, 1))
    near = (first <= k) & (first + second <= checked)
    must = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if near[i, j] and 5 * both >= 4 * (n[i] + n[j] - both) and prints[i].tolist() != prints[j].tolist():
                must += 1
                assert own[i] & own[j]
    assert must > 100
    root = local_roots(len(sets), *np.nonzero(near))
    for i in range(len(sets)):
        assert not any(own[i] & own[j] for j in range(i) if root[i] != root[j])


def test_copies_of_common_keys_are_dealt_some_at_a_time(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 10)
    monkeypatch.setattr(simhash, "DEALT", 1000)
    sets = [np.arange(5, dtype=np.uint64) + np.uint64(100 * (i % 2)) for i in range(400)]
    order = order_of(sets)  # keys of 200 rows, 20 tiles each
    zero = np.arange(400)
    batch = pa.RecordBatch.from_arrays([pa.array([order.keys(s, 80).tobytes() for s in sets], pa.binary()), *map(pa.array, (zero, zero, zero))], names=["keys", "fp", "fq", "n"])
    dealt = [np.frombuffer(utf8(b.column(1))[0].tobytes(), simhash.ENTRY) for b in simhash._deal(order, 5)(iter([batch]))]
    assert max(map(len, dealt)) <= 1000 and sum(map(len, dealt)) == 400 * 2 * 20
    key, fp = (np.concatenate([d[c] for d in dealt]) for c in ("key", "fp"))
    held = [set(key[fp == i].tolist()) for i in range(400)]
    assert all(len(h) == 40 for h in held) and all(held[0] & held[i] for i in range(0, 400, 2))
    assert not any(held[0] & held[i] for i in range(1, 400, 2)) and np.unique(key, return_counts=True)[1].max() < 60


def test_unrelated_texts_do_not_meet(spark, monkeypatch):
    """A common line, and fingerprints' bits, let no unrelated texts be compared: before,
    two of them shared half a probe of bits on average."""

    def probes(*_):
        raise AssertionError("texts are dealt by bits alone")

    monkeypatch.setattr(simhash, "_dealt", probes)
    rnd = random.Random(3)
    line = " ".join(f"stock{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rnd.randint(0, 99999)}" for _ in range(60)) + f"\n{line}") for i in range(400)]
    rows += [(1000 + i, rows[i][1].replace(line, line + " more")) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(range(400))
    texts = docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("row_hash"))
    order = simhash.rarest(texts, 5)
    assert len(order.common) >= 26 and order.times.max() == 420
    raw, offsets = utf8(pa.array([t for _, t in rows]))
    keys, times = np.unique(np.concatenate([order.keys(s, 80) for s in sets_of(raw, offsets, 5)]), return_counts=True)
    assert times.max() <= 4 and (times * (times - 1) // 2).sum() < 20 * 30


def test_counts_are_of_different_texts_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_COMMON", 5)
    rows = [(i, f"own{i} a b c d e f g h i j k l") for i in range(6)] + [(100 + i, "copy of one text again and again") for i in range(50)] + [(200, None), (201, "")]
    texts = spark.createDataFrame(rows, SCHEMA)
    order = simhash.rarest(texts, 5)
    assert order.times.tolist() == [6] * 5 and (np.diff(order.common.astype(float)) > 0).all()
    assert simhash.rarest(texts.limit(0), 5).keys(np.arange(10, dtype=np.uint64), 80).tolist() == [0, 1, 2]
