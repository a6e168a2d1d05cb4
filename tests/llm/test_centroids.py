"""Operator 13 against plain Python integers."""

import hashlib
import math
import random

import pytest

from millrace.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds, dims, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    current = [v for _, _, v in sorted((digest(i), -1 if i is None else i, v) for i, v in kept)][:k]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((square(v, c), n) for n, c in enumerate(current))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own) if o == n] for n in range(len(current))]
        current = [[sum(c) // len(g) for c in zip(*g)] if g else was for g, was in zip(groups, current)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {n: sum(d for _, o, d in found if o == n) for n in range(len(current))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in current]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name[c]) for i, c, d in found), key=str)


def awkward(n, dims, seed=0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.25, rnd.uniform(-1, 1)]) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * dims) for i in range(40)]  # a hot vector
    rows += [(5, rows[5][1]), (5, [0.125] * dims), (None, [0.3] * dims), (None, [0.3] * dims)]
    return rows + [(2000, None), (2001, []), (2002, [1.0] * (dims - 1)), (2003, [None] + [1.0] * (dims - 1)), (2004, [math.nan] + [1.0] * (dims - 1)), (2005, [-math.inf] * dims)]


@pytest.mark.parametrize("k, rounds, dims", [(8, 10, 4), (3, 1, 6), (5, 0, 3)])
def test_equals_brute_force(spark, k, rounds, dims):
    rows = awkward(90, dims, k)
    got = centroids.cluster(frame(spark, rows), k, rounds, dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, rounds, dims)


def test_few_equal_and_no_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-3.0, 0.1])]  # two equal centroids: one stays without vectors
    assert sorted(map(tuple, centroids.cluster(frame(spark, few), 8, 4, 2).collect()), key=str) == brute(few, 8, 4, 2)
    assert centroids.cluster(frame(spark, []), dims=2).count() == 0
    assert centroids.cluster(frame(spark, [(1, None), (2, [1.0])]), dims=2).count() == 0


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [(-1) ** i * 131071.9 / (i + 1), 131071.99, 7.5 * i]) for i in range(30)]
    assert sorted(map(tuple, centroids.cluster(frame(spark, rows), 4, 5, 3).collect()), key=str) == brute(rows, 4, 5, 3)
    with pytest.raises(Exception, match="scaled components must be below"):
        centroids.cluster(frame(spark, [(1, [1e30, 0.0])]), dims=2).collect()


def test_a_round_adds_only_changes():
    """The second round's task reads what the first left and the changed components alone."""
    import numpy as np
    import pyarrow as pa

    x = np.array([[1, 2, 3], [4, 5, 6]], np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), centroids._lists(x, 3), centroids._lists(np.array([[100, 7], [200, 7]]), 2)], names=["vec_id", "x", "dots"])
    change = np.array([[0, 10, 0], [0, 0, 0]])
    (out,) = centroids._updated(change, np.array([0, 0]), 3)(iter([batch]))
    assert out.column(2).to_pylist() == [[120, 7], [250, 7]]
