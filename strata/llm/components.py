"""Connected components of an edge table, by alternating large-star and small-star rounds, or by union-find inside tasks
first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import release, stored

#: Edges that a task joins by itself.
TASK_EDGES = 200_000


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes other than roots, and their roots, the least nodes that the edges reach: a union-find in which all edges are
    looked at side by side, roots hang on lesser roots, and paths are halved until they are flat."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task to one for each node but the roots."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for k in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000]), pa.array(v[k : k + 100_000])], ["u", "v"])
    release()


def _lowest(edges: DataFrame) -> DataFrame:
    """u and the least of its neighbours and itself; summed up before the shuffle, so that hubs are no burden."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, component (the least node reachable) for all nodes of the edges u, v (long). Each round is a stored table,
    so lineage stays short; rounds grow with the logarithm of a component's diameter,
    and what isn't joined after `rounds` of them is an error."""
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(both, "edges")
    mark = None
    for _ in range(rounds):
        # Large star: every larger neighbour to the least neighbour.
        sides = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = sides.where("v > u").join(_lowest(sides), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour, and the node, to the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = _lowest(down)
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "edges")
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was:
            break
    else:
        raise RuntimeError(f"components are not joined after {rounds} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.groupBy("node").agg(F.min("component").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def union_find(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """As components. Edges are dealt out to as many tasks as their number asks for, `task_edges` each, and every task leaves
    a forest, an edge a node. If one task has them all, that is the result; else rounds of stars join the forests."""
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tasks = edges.count() // task_edges + 1
    forest = stored(both.repartition(tasks).mapInArrow(_forest, "u long, v long"), "forest")
    if tasks > 1:
        return components(forest)
    roots = forest.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
