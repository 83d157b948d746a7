"""Strongly connected components by rounds of trimming and colouring.

Each round peels off nodes that cannot lie on a cycle, then gives every node the least name that reaches it (its colour) and,
inside a colour, the least name that it reaches. Where both are the same name, that name's component is found: it leaves,
and so do edges between colours. Names spread along edges and, as what reaches a colour's node reaches its nodes too,
from each node's colour to the node, so the stretch that a name has covered grows by a factor in each step, on long
cycles too, and no set of mutual pairs is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.scratch import stash

#: Steps of a round before it is written; a plan grows by a factor of three or four with each.
STEPS = 2


def trimmed(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """Edges (a, b) without nodes that lack a predecessor or a successor, as long as a round takes away a tenth; what
    is left of thin tails costs colouring little."""
    n = edges.count()
    while n:
        e = edges
        for _ in range(steps):
            e = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        edges, before = stash(e, "scc-trim"), n
        n = edges.count()
        if n > before * 0.9:
            break
    return edges


def least_reaching(edges: DataFrame, nodes: DataFrame, steps: int = STEPS) -> DataFrame:
    """node, colour: the least name of those that reach a node along edges (a, b), its own included."""
    colours = stash(nodes.select("node", F.col("node").alias("colour")), "scc-colours")
    while True:
        now = colours
        for _ in range(steps):
            pushed = edges.join(now.select(F.col("node").alias("a"), "colour"), "a").select(F.col("b").alias("node"), "colour")
            own = now.unionByName(pushed).groupBy("node").agg(F.min("colour").alias("colour"))
            # The colour's own colour reaches the node as well.
            now = own.join(own.select(F.col("node").alias("colour"), F.col("colour").alias("next")), "colour").select("node", F.col("next").alias("colour"))
        new = stash(now, "scc-colours")
        moved = new.join(colours, ["node", "colour"], "left_anti").isEmpty()
        colours = new
        if moved:
            return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """node, scc: the nodes of edges (child, parent) that lie on cycles, with the least name of their component.

    Nodes on no cycle, and edges from a node to itself, have no row. Repeated edges count once.
    """
    rest = stash(edges.filter("child <> parent").select(F.col("child").alias("a"), F.col("parent").alias("b")).distinct(), "scc-edges")
    found: DataFrame | None = None
    while True:
        rest = trimmed(rest)
        if rest.isEmpty():
            break
        nodes = stash(rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct(), "scc-nodes")
        colours = least_reaching(rest, nodes)
        ends = colours.select(F.col("node").alias("a"), F.col("colour").alias("ca"))
        rest = rest.join(ends, "a").join(ends.toDF("b", "cb"), "b").filter("ca = cb").select("a", "b")
        rest = stash(rest, "scc-edges")  # inside colours
        back = least_reaching(rest.select(F.col("b").alias("a"), F.col("a").alias("b")), nodes)
        whole = stash(colours.join(back.withColumnRenamed("colour", "back"), "node").filter("colour = back").select("node", F.col("colour").alias("scc")), "scc-found")
        # A component of one node is a node on no cycle.
        many = whole.join(whole.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1").select("scc"), "scc", "left_semi").select("node", "scc")
        found = many if found is None else found.unionByName(many)
        rest = stash(rest.join(whole.select(F.col("node").alias("a")), "a", "left_anti").join(whole.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "scc-edges")
    return found if found is not None else edges.sparkSession.createDataFrame([], "node string, scc string")
