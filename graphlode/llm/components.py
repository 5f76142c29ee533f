"""Connected components by alternating large-star and small-star steps.

Edges stay in tables; no link or component reaches the driver.  Each step is an
aggregation with map-side combining and an equi-join, so a vertex with very many
neighbours is a skewed join key that adaptive execution splits.

A step costs several shuffles however few its edges are.  So edges up to ``FEW``,
at the start or after any step, are settled by one task, whose memory that bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Edges that one task settles: 16 bytes each, about ten times that with its index arrays.
FEW = 1 << 20


def least_neighbour(arcs: DataFrame) -> DataFrame:
    """``u`` and ``m``, the least of ``u`` and its neighbours, from arcs (u, v)."""
    return arcs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))


def turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(turned(edges))
    return both.join(least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = least_neighbour(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def least_reachable(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (x, y), sorted, and the least vertex reachable from each.

    Each round hooks every root to the least root beside it and shortens all paths,
    which at least halves the roots in two rounds.
    """
    vertices, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    up = np.arange(len(vertices))
    while True:
        p, q = up[x], up[y]
        apart = p != q
        if not apart.any():
            return vertices, vertices[up]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up != (further := up[up])).any():
            up = further


def settled(edges: DataFrame) -> DataFrame:
    """``v`` and ``component`` from edges (u, v) that fit a task."""

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        x, y = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (zip(*held) if held else ([], [])))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in least_reachable(x, y)], ["v", "component"])

    return stash(edges.repartition(1).mapInArrow(run, "v long, component long"), "components")


def components(edges: DataFrame, a: str, b: str, few: int = FEW) -> DataFrame:
    """``v`` and ``component``, the least vertex reachable, for every vertex with an edge.

    ``edges`` are counted before they are read, so they had best be a written table.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v")
    if pairs.count() <= few:
        return settled(pairs)
    now = stash(pairs.distinct(), "edges", few=True)
    seen = mark(now)
    while seen[0] > few:
        now = stash(small_star(large_star(now)), "edges", few=True)
        then, seen = seen, mark(now)
        if then == seen:
            stars = now.select(F.col("u").alias("v"), F.col("v").alias("component"))
            return stars.unionByName(now.select("v", F.col("v").alias("component"))).groupBy("v").agg(F.min("component").alias("component"))
    return settled(now)
