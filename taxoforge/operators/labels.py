"""Reachability by two-hop labels, for many has-path questions without the closure.

Every node gets two sets of hubs: those that it reaches (side "out") and those that reach it (side "in"). One node reaches
another if an out-hub of the first is an in-hub of the second. Hubs are ordered by degree, greater ones first; a hub
is a node's label only if no greater hub lies on a way between the two. These are the labels that growing them hub by hub
would give, but all grow at once here, a step along the edges in each round: a hub goes on to lesser nodes only, and not to
nodes where greater hubs answer the question already. Labels that became needless later go at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoforge.scratch import stash

LABELS = "side string, node string, hub string, w long"


def _key(w: str, name: str) -> Column:
    """The order of hubs: by weight, then by name, so that no two are equal."""
    return F.struct(F.col(w).alias("w"), F.col(name).alias("n"))


def hub_weights(edges: DataFrame) -> DataFrame:
    """node, w: (children + 1) * (parents + 1), of edges taken once."""
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("parent", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(((F.sum("up") + 1) * (F.sum("down") + 1)).cast("long").alias("w"))


def _answered(some: DataFrame, labels: DataFrame) -> DataFrame:
    """Of labels (side, node, hub, w) those whose node and hub meet in a greater hub."""
    own = labels.select("side", "node", F.col("hub").alias("via"), F.col("w").alias("via_w"))
    far = labels.select(F.when(F.col("side") == "out", "in").otherwise("out").alias("side"), F.col("node").alias("hub"), F.col("hub").alias("via"))
    ways = some.join(own, ["side", "node"]).filter(_key("via_w", "via") > _key("w", "hub"))
    return ways.join(far, ["side", "hub", "via"], "left_semi").select("side", "node", "hub").distinct()


def reach_labels(edges: DataFrame) -> DataFrame:
    """side, node, hub, w (the hub's weight), for the nodes of edges (child, parent), which may have cycles.

    Repeated edges count once, edges from a node to itself not at all (their nodes have labels only through other edges).
    There are as many rounds as steps on the longest of the shortest ways.
    """
    e = stash(edges.filter("child <> parent").select("child", "parent").distinct(), "labels-edges")
    nodes = stash(hub_weights(e), "labels-nodes")
    # Out-labels go from parents down to children, in-labels from children up to parents.
    steps = e.select(F.lit("out").alias("side"), F.col("parent").alias("at"), F.col("child").alias("to")).unionAll(e.select(F.lit("in"), "child", "parent"))
    steps = stash(steps.join(nodes.select(F.col("node").alias("to"), F.col("w").alias("to_w")), "to"), "labels-steps")
    labels = stash(nodes.select(F.explode(F.array(F.lit("out"), F.lit("in"))).alias("side"), "node", F.col("node").alias("hub"), "w"), "labels")
    front = labels
    while True:
        grown = front.join(steps.withColumnRenamed("at", "node"), ["side", "node"]).filter(_key("w", "hub") > _key("to_w", "to"))
        grown = grown.select("side", F.col("to").alias("node"), "hub", "w").distinct().join(labels, ["side", "node", "hub"], "left_anti")
        grown = stash(grown, "labels-grown")
        front = stash(grown.join(_answered(grown, labels), ["side", "node", "hub"], "left_anti"), "labels")
        if front.isEmpty():
            break
        labels = labels.unionByName(front)
    labels = stash(labels, "labels")
    return labels.join(_answered(labels, labels), ["side", "node", "hub"], "left_anti").select("side", "node", "hub", "w")


def has_path(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (child, parent), each once, whose child is the parent or lies below it."""
    up = labels.filter("side = 'out'").select(F.col("node").alias("child"), "hub")
    down = labels.filter("side = 'in'").select(F.col("node").alias("parent"), "hub")
    return pairs.select("child", "parent").distinct().join(up, "child").join(down, ["parent", "hub"], "left_semi").select("child", "parent").distinct()


def subclass_of_any(pairs: DataFrame, labels: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (key, cls), each once, whose class is one of, or below one of, the key's allowed (key, anc). A
    key's allowed classes become one set of hubs, so the number of allowed classes doesn't multiply the pairs."""
    up = labels.filter("side = 'out'").select(F.col("node").alias("cls"), "hub")
    hubs = allowed.join(labels.filter("side = 'in'").select(F.col("node").alias("anc"), "hub"), "anc").select("key", "hub").distinct()
    return pairs.select("key", "cls").distinct().join(up, "cls").join(hubs, ["key", "hub"], "left_semi").select("key", "cls").distinct()
