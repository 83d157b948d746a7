"""A closure and a transitive reduction kept up while edges come and go.

Deletions are over-estimated and derived again: a pair is suspect if a deleted edge lies on one of its shortest ways, which
the old distances tell; suspects leave, and those that other ways still join come back, shortest first through pairs
that were never in doubt. Insertions add the ways through new edges, once more for as long as a shorter way through
several of them turns up. Pairs that no changed edge touches are carried over as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.operators.closure import nodes_of
from taxoforge.scratch import stash

PAIR = ["node", "anc"]


@dataclass
class Maintained:
    """edges (child, parent) and full (node, anc, dist) after the changes; suspects and changed (node, anc): pairs worked out
    again, and pairs that came, went or have another distance; parents (parent): those that lost or got a child."""

    edges: DataFrame
    full: DataFrame
    suspects: DataFrame
    changed: DataFrame
    parents: DataFrame


def _through(up: DataFrame, links: DataFrame, down: DataFrame) -> DataFrame:
    """node, anc, dist: least ways over exactly one of the links, between rows of up that end at its child and rows of
    down that begin at its parent."""
    over = up.select("node", F.col("anc").alias("child"), F.col("dist").alias("d1")).join(links, "child")
    over = over.join(down.select(F.col("node").alias("parent"), "anc", F.col("dist").alias("d2")), "parent").filter("node <> anc")
    return over.groupBy(PAIR).agg(F.min(F.col("d1") + F.col("d2") + 1).cast("int").alias("dist"))


def _least(*parts: DataFrame) -> DataFrame:
    every = parts[0].select(*PAIR, "dist")
    for p in parts[1:]:
        every = every.unionByName(p.select(*PAIR, "dist"))
    return every.groupBy(PAIR).agg(F.min("dist").alias("dist"))


def _suspects(full: DataFrame, gone: DataFrame) -> DataFrame:
    """Pairs with a deleted edge on a shortest way."""
    ways = full.select("node", F.col("anc").alias("child"), F.col("dist").alias("d1")).join(gone, "child")
    ways = ways.join(full.select(F.col("node").alias("parent"), "anc", F.col("dist").alias("d2")), "parent")
    ways = ways.select(*PAIR, (F.col("d1") + F.col("d2") + 1).alias("dist")).distinct()
    return full.join(ways, [*PAIR, "dist"], "left_semi").select(PAIR)


def _derive_again(suspects: DataFrame, kept: DataFrame, edges: DataFrame) -> DataFrame:
    """node, anc, dist of the suspects that the remaining edges still join."""
    asks = stash(suspects.join(edges.select(F.col("child").alias("node"), F.col("parent").alias("next")), "node"), "derive-asks")

    def step(known: DataFrame) -> DataFrame:
        return asks.join(known.select(F.col("node").alias("next"), "anc", "dist"), ["next", "anc"]).groupBy(PAIR).agg((F.min("dist") + 1).cast("int").alias("dist"))

    found = front = stash(step(kept), "derive")
    while not front.isEmpty():
        better = step(front).join(found.withColumnRenamed("dist", "had"), PAIR, "left").filter("had is null or dist < had").select(*PAIR, "dist")
        front = stash(better, "derive")
        found = stash(_least(found, front), "derive")
    return found


def maintain_closure(full: DataFrame, edges: DataFrame, deleted: DataFrame, inserted: DataFrame) -> Maintained:
    """The reflexive closure after the changes, from the one before (node, anc, dist) and its edges (child, parent).

    Deleted edges that aren't there and inserted ones that are don't count; an edge that is both is there in the end; edges
    from a node to itself don't count; repeated edges count once; nodes without an edge left go. Cycles may come and go.
    """
    pick = lambda df: df.filter("child <> parent").select("child", "parent").distinct()
    both = ["child", "parent"]
    old, wanted = stash(pick(edges), "maintain-edges"), stash(pick(inserted), "maintain-wanted")
    gone = stash(pick(deleted).join(old, both, "left_semi").join(wanted, both, "left_anti"), "maintain-gone")
    come = stash(wanted.join(old, both, "left_anti"), "maintain-come")
    rest = stash(old.join(gone, both, "left_anti"), "maintain-rest")
    after = stash(rest.unionByName(come), "maintain-after")

    suspects = stash(_suspects(full, gone), "maintain-suspects")
    kept = full.join(suspects, PAIR, "left_anti")
    derived = _derive_again(suspects, kept, rest)
    nodes = stash(nodes_of(after), "maintain-nodes")
    now = kept.filter("node <> anc").unionByName(derived).unionByName(nodes.select("node", F.col("node").alias("anc"), F.lit(0).cast("int").alias("dist")))

    # Only rows that end where new edges begin, or begin where they end, can become part of a new way.
    low, high = come.select(F.col("child").alias("anc")).distinct(), come.select(F.col("parent").alias("node")).distinct()
    up, down = stash(now.join(low, "anc", "left_semi"), "maintain-up"), stash(now.join(high, "node", "left_semi"), "maintain-down")
    best = stash(now.select(*PAIR, "dist").limit(0), "maintain-best")
    while True:
        ways = _through(_least(up, best.join(low, "anc", "left_semi")), come, _least(down, best.join(high, "node", "left_semi")))
        had = now.select(*PAIR, F.col("dist").alias("had"))
        better = ways.join(best.withColumnRenamed("dist", "best"), PAIR, "left").filter("best is null or dist < best").join(had, PAIR, "left").filter("had is null or dist < had")
        new = stash(better.select(*PAIR, "dist"), "maintain-new")
        if new.isEmpty():
            break
        best = stash(_least(best, new), "maintain-best")
    result = stash(now.join(best, PAIR, "left_anti").select(*PAIR, "dist").unionByName(best), "maintain-full")
    same = suspects.join(full, PAIR).join(derived, [*PAIR, "dist"], "left_semi").select(PAIR)
    changed = stash(suspects.join(same, PAIR, "left_anti").unionByName(best.select(PAIR)).distinct(), "maintain-changed")
    parents = gone.unionByName(come).select("parent").distinct()
    return Maintained(after, result, suspects, changed, parents)


def redundant_edges(some: DataFrame, edges: DataFrame, full: DataFrame) -> DataFrame:
    """Of the edges ``some`` those that another way around them makes needless; full is the closure of ``edges``."""
    above = full.filter("node <> anc").join(some.select(F.col("child").alias("node")).distinct(), "node", "left_semi")
    ways = above.select(F.col("node").alias("child"), F.col("anc").alias("over")).join(edges.select(F.col("child").alias("over"), "parent"), "over")
    return some.join(ways.select("child", "parent").distinct(), ["child", "parent"], "left_semi")


def maintain_redundant(redundant: DataFrame, m: Maintained) -> DataFrame:
    """The edges (child, parent) that the reduction leaves out, after the changes, from those before: only edges below a
    changed pair or beside a changed child are looked at again."""
    both = ["child", "parent"]
    touched = m.edges.join(m.changed.select(F.col("node").alias("child")).distinct(), "child", "left_semi").select(both)
    again = stash(touched.unionByName(m.edges.join(m.parents, "parent", "left_semi").select(both)).distinct(), "maintain-again")
    as_before = redundant.select(both).distinct().join(m.edges, both, "left_semi").join(again, both, "left_anti")
    return as_before.unionByName(redundant_edges(again, m.edges, m.full))
