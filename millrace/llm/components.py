"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint

#: Links from which on a node is a hub, and the most hubs that are sent to every task.
HUB, MOST_HUBS = 256, 2000


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node of its component, for edges held in one task."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(root, before):
            break
    return root


def _star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's links lead to the smallest node around it. A node of many links is not
    dealt to one task: such nodes, at most ``MOST_HUBS`` by their least number of links, go to
    the links instead of the links to them."""
    hub = max(HUB, n // MOST_HUBS)
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    if n <= hub:
        return edges.join(least.drop("n"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("u", "m"))
    known = edges.join(hubs, "u", "left")
    rest = known.filter("m is null").drop("m").join(least.drop("n"), "u")
    return known.filter("m is not null").unionByName(rest)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge to another.

    ``edges`` has columns u and v of one type. Each round sends the larger neighbours of a
    node, then its smaller ones, to the smallest node around it; no node's links are gathered
    in one task, as minima are aggregated first and joined back. Rounds end when the edges no
    longer change.
    """
    now = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = _star(both, 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # written down, as each star reads its links several times over
        small = _star(checkpoint(large), mark[0])
        led = small.select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        now = checkpoint(led.filter("u <> v").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
