"""Reachability over edges (child, parent): closures, depths, path counts, nearest kept ancestors.

All are frontier loops. A round takes HOPS steps from the last frontier in one plan, keeps what is new and writes it
to the shared folder, so plans stay short, lost executors reread tables, and the work is in proportion to the pairs
found, not to the paths. Diamonds cost nothing, cycles end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.scratch import stash

HOPS = 4
#: Longest path that counts are followed along.
GUARD = 200


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()


def reach(known: DataFrame, steps: DataFrame, hops: int = HOPS, far: int = 0) -> DataFrame:
    """src, node, dist: the pairs ``known`` (src, node, dist), a table with each pair once, and all that is reached from
    those ``far`` steps away, the farthest, along ``steps`` (at, to), a table too."""
    seen, front = known, known.filter(F.col("dist") == far)
    while True:
        layers, layer = [], front
        for hop in range(hops):
            layer = layer.join(steps, F.col("node") == F.col("at")).select("src", F.col("to").alias("node"), (F.col("dist") + 1).alias("dist"))
            layers.append(layer)
            if hop % 2:
                layer = layer.distinct()
        grown = layers[0]
        for more in layers[1:]:
            grown = grown.unionByName(more)
        new = stash(grown.groupBy("src", "node").agg(F.min("dist").alias("dist")).join(seen, ["src", "node"], "left_anti"), "reach")
        far += hops
        seen, front = seen.unionByName(new), new.filter(F.col("dist") == far)
        if front.isEmpty():
            return seen


def upward(edges: DataFrame) -> DataFrame:
    return edges.filter("child <> parent").select(F.col("child").alias("at"), F.col("parent").alias("to"))


def downward(edges: DataFrame) -> DataFrame:
    return edges.filter("child <> parent").select(F.col("parent").alias("at"), F.col("child").alias("to"))


def strict_closure(edges: DataFrame, stored: bool = False) -> DataFrame:
    """node, anc, dist of proper paths: dist is 1 or more; nodes on cycles reach themselves. Edges that are ``stored``, a
    table with each edge once, are not written again."""
    up = upward(edges) if stored else stash(upward(edges).distinct(), "steps")
    known = up.select(F.col("at").alias("src"), F.col("to").alias("node"), F.lit(1).cast("int").alias("dist"))
    return reach(known, up, far=1).select(F.col("src").alias("node"), F.col("node").alias("anc"), "dist")


def closure(edges: DataFrame, strict: DataFrame | None = None) -> DataFrame:
    """node, anc, dist: every node with itself (0) and its ancestors at their least distance."""
    own = nodes_of(edges).select("node", F.col("node").alias("anc"), F.lit(0).alias("dist"))
    return own.unionByName((strict if strict is not None else strict_closure(edges)).filter("node <> anc"))


def _around(start: DataFrame, steps: DataFrame) -> DataFrame:
    """src, node, dist: the nodes of ``start`` (node), what is one step away, and on from there."""
    own = start.select(F.col("node").alias("src"), "node").distinct()
    near = own.join(steps, F.col("node") == F.col("at")).select("src", F.col("to").alias("node"), F.lit(1).cast("int").alias("dist")).distinct()
    return reach(stash(own.withColumn("dist", F.lit(0).cast("int")).unionByName(near), "reach"), steps, far=1)


def ancestors(edges: DataFrame, start: DataFrame, stored: bool = False) -> DataFrame:
    """src, node, dist: the nodes of ``start`` (node) and their ancestors, for few nodes of a large graph."""
    return _around(start, upward(edges) if stored else stash(upward(edges).distinct(), "steps"))


def descendants(edges: DataFrame, start: DataFrame, stored: bool = False) -> DataFrame:
    """src, node, dist: the nodes of ``start`` (node) and their descendants."""
    return _around(start, downward(edges) if stored else stash(downward(edges).distinct(), "steps"))


def depths(edges: DataFrame, root: str, stored: bool = False) -> DataFrame:
    """node, depth: least distance from the root, for what it reaches."""
    one = edges.sparkSession.createDataFrame([(root,)], "node string")
    return descendants(edges, one, stored).select("node", F.col("dist").alias("depth"))


def root_paths(edges: DataFrame, root: str, root_counts: int = 0, guard: int = GUARD) -> DataFrame:
    """node, paths: number of paths from the root, summed level by level, never enumerated; the root has root_counts."""
    down = stash(downward(edges).distinct(), "steps")
    layer = edges.sparkSession.createDataFrame([(root, 1)], "node string, paths long")
    parts, length = [], 0
    while length < guard:
        layers = []
        for _ in range(min(HOPS, guard - length)):
            layer = layer.join(down, F.col("node") == F.col("at")).groupBy(F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
            length += 1
            layers.append(layer.withColumn("length", F.lit(length)))
        every = layers[0]
        for more in layers[1:]:
            every = every.unionByName(more)
        part = stash(every, "paths")
        if part.isEmpty():
            break
        parts.append(part)
        layer = part.filter(F.col("length") == length).select("node", "paths")
    total = edges.sparkSession.createDataFrame([(root, root_counts, 0)], "node string, paths long, length int")
    for part in parts:
        total = total.unionByName(part)
    return total.groupBy("node").agg(F.sum("paths").alias("paths"))


def nearest_kept(edges: DataFrame, kept: DataFrame, stored: bool = False) -> DataFrame:
    """node, anc, dist: the first nodes of ``kept`` (node) on every way up from each node, which itself may be kept."""
    keep = stash(kept.select("node").distinct(), "kept")
    up = upward(edges) if stored else stash(upward(edges).distinct(), "steps")
    through = stash(up.join(keep, F.col("at") == F.col("node"), "left_anti"), "steps")
    known = up.select(F.col("at").alias("src"), F.col("to").alias("node"), F.lit(1).cast("int").alias("dist"))
    found = reach(known, through, far=1).select(F.col("src").alias("node"), F.col("node").alias("anc"), "dist")
    return found.join(keep.withColumnRenamed("node", "anc"), "anc", "left_semi").select("node", "anc", "dist")


def reachable_leaves(edges: DataFrame, strict: DataFrame) -> DataFrame:
    """node, leaf: the childless descendants of each node; a leaf is its own."""
    leaves = edges.select(F.col("child").alias("leaf")).distinct().join(edges.select(F.col("parent").alias("leaf")), "leaf", "left_anti")
    below = strict.select(F.col("anc").alias("node"), F.col("node").alias("leaf")).join(leaves, "leaf", "left_semi").select("node", "leaf")
    return below.unionByName(leaves.select(F.col("leaf").alias("node"), "leaf"))


def is_subclass_of_any(pairs: DataFrame, full: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (key, cls) whose class is one of, or below one of, the key's allowed (key, anc)."""
    return pairs.join(full, F.col("cls") == F.col("node")).join(allowed.distinct(), ["key", "anc"], "left_semi").select("key", "cls").distinct()
