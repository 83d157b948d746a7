"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.llm.common import stash

#: Edges that a task holds at a time while it thins them to a forest.
CHUNK_EDGES = 1 << 20


def thin(edges: DataFrame) -> DataFrame:
    """Replace each chunk of a task's edges (a, b) by a spanning forest: node to the smallest node of its tree."""

    def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = flat[: len(a)], flat[len(a) :]
        root = np.arange(len(nodes))
        while True:
            ru, rv = root[u], root[v]
            low, high = np.minimum(ru, rv), np.maximum(ru, rv)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[own]]), pa.array(nodes[own])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0
        for batch in batches:
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            a.append(x)
            b.append(y)
            n += len(x)
            if n >= CHUNK_EDGES:
                yield forest(np.concatenate(a), np.concatenate(b))
                a, b, n = [], [], 0
        if n:
            yield forest(np.concatenate(a), np.concatenate(b))

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): equal roots for nodes that are connected, root a node of theirs.

    Each round points every node at its least neighbour, follows the pointers once more and carries the edges over,
    which shrinks them by a constant factor for nodes in no special order; the maps of all rounds are joined at the
    end. Edges stay in tables throughout; each round is written to the shared folder. Hot nodes lose their weight to
    the partial minimum and to the per-task forests.
    """
    maps: list[DataFrame] = []
    current = stash(thin(edges.filter("a <> b")).distinct(), "cc-edges")
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        low = stash(low, "cc-parents")
        up = low.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        step = stash(low.join(up, "parent").select("node", "root"), "cc-map")
        maps.append(step)
        first = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        second = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = current.join(first, "a").join(second, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        current = stash(thin(moved.filter("a <> b")).distinct(), "cc-edges")
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0]
    for step in maps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
