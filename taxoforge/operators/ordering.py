"""The order in which edge edits look at edges, and which edges a rooted extraction may take."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoforge.functions.vectors import dot
from taxoforge.operators.closure import closure, depths
from taxoforge.operators.scc import strong_components
from taxoforge.scratch import stash


#: Rows of a range of numbers whose sums are taken together.
RANGE_ROWS = 4096


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with each row's place, from 1, in the order of ``keys``, which must tell all rows apart. Rows are dealt into ranges
    of the order, numbered inside each, and moved up by what the ranges before hold; one small row per range comes together."""
    dealt = stash(df.repartitionByRange(*keys).withColumn("range_no", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("range_no").agg(F.count("*").alias("range_n"))
    before = sizes.select("range_no", (F.sum("range_n").over(Window.orderBy("range_no")) - F.col("range_n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*keys))
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "range_no").withColumn(name, F.col("before") + F.col("inside")).drop("range_no", "inside", "before")


def running_sum(df: DataFrame, number: str, value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` up to each row, in the order of ``number``, places from 1 without gaps."""
    cut = df.withColumn("range_no", F.floor(F.col(number) / RANGE_ROWS))
    sums = cut.groupBy("range_no").agg(F.sum(value).alias("range_sum"))
    before = sums.select("range_no", (F.sum("range_sum").over(Window.orderBy("range_no")) - F.col("range_sum")).alias("before"))
    inside = F.sum(value).over(Window.partitionBy("range_no").orderBy(number))
    return cut.withColumn("inside", inside).join(before, "range_no").withColumn(name, F.col("before") + F.col("inside")).drop("range_no", "inside", "before")


def edge_order(edges: DataFrame, root: str) -> DataFrame:
    """child, parent, level, ins, ord: by level of the parent, then parents of the child (most first), child, parent
    (both last name first)."""
    e = edges.select("child", "parent").distinct()
    ins = e.groupBy("child").agg(F.count("*").alias("ins"))
    level = depths(e, root).select(F.col("node").alias("parent"), F.col("depth").alias("level"))
    keys = [F.col("level"), F.desc("ins"), F.desc("child"), F.desc("parent")]
    return numbered(e.join(ins, "child").join(level, "parent").select("child", "parent", "level", "ins"), keys, "ord")


def order_by_similarity(ordered: DataFrame, similarity: DataFrame, ascending: bool = True) -> DataFrame:
    """The same with ``ord`` renumbered: inside runs of consecutive edges with equal (ins, child), by similarity
    (child, parent, sim); stable. Runs may cross levels."""
    ordered = stash(ordered, "ordered")
    last = ordered.select((F.col("ord") + 1).alias("ord"), F.col("ins").alias("last_ins"), F.col("child").alias("last_child"))
    same = (F.col("last_ins") == F.col("ins")) & (F.col("last_child") == F.col("child"))
    starts = ordered.join(last, "ord", "left").withColumn("start", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).drop("last_ins", "last_child")
    runs = running_sum(starts, "ord", "start", "run").drop("start")
    key = F.col("sim").asc_nulls_last() if ascending else F.col("sim").desc_nulls_last()
    both = runs.join(similarity.select("child", "parent", "sim"), ["child", "parent"], "left").withColumnRenamed("ord", "old")
    return numbered(both, [F.col("run"), key, F.col("old")], "ord").select("child", "parent", "level", "ins", "run", "sim", "ord")


def edge_similarity(edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """child, parent, sim: dot products of the ends' vectors (node, vec), for the edges only."""
    c = embeddings.select(F.col("node").alias("child"), F.col("vec").alias("cv"))
    p = embeddings.select(F.col("node").alias("parent"), F.col("vec").alias("pv"))
    return edges.join(c, "child").join(p, "parent").select("child", "parent", dot(F.col("cv"), F.col("pv")).alias("sim"))


def missing_nodes(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Nodes without a vector."""
    return nodes.join(embeddings.select("node"), "node", "left_anti")


def rooted_extraction(edges: DataFrame, root: str, valid: DataFrame, metaclasses: DataFrame) -> DataFrame:
    """The acyclic part of a raw subclass graph that hangs on the root.

    An edge is followed if its child is valid (node) and no metaclass (node); the root's own children are taken as they
    are. Cycles lie inside strongly connected components: there edges are tried in the order (depth of the parent,
    parent, child), those that would close a loop left out, one component a task. All other edges stay.
    """
    e = edges.filter("child <> parent").select("child", "parent").distinct()
    good = valid.select("node").distinct().join(metaclasses.select("node"), "node", "left_anti").withColumnRenamed("node", "child")
    taken = stash(e.filter((F.col("parent") == root) & (F.col("child") != root)).unionByName(e.filter((F.col("parent") != root) & (F.col("child") != root)).join(good, "child", "left_semi").select("child", "parent")), "extract")
    d = stash(depths(taken, root, stored=True), "extract-depth")
    taken = stash(taken.join(d.select(F.col("node").alias("parent")), "parent", "left_semi").select("child", "parent"), "extract")
    comp = stash(strong_components(taken), "scc")
    if comp.isEmpty():
        return taken
    own = taken.join(comp.select(F.col("node").alias("child"), F.col("scc").alias("a")), "child").join(comp.select(F.col("node").alias("parent"), F.col("scc").alias("b")), "parent").filter("a = b")
    own = own.join(d.withColumnRenamed("node", "parent"), "parent").select("a", "child", "parent", "depth")

    def acyclic(pdf: pd.DataFrame) -> pd.DataFrame:
        order = AcyclicOrder()
        gone = [(r.child, r.parent) for r in pdf.sort_values(["depth", "parent", "child"], kind="stable").itertuples(index=False) if not order.add(r.child, r.parent)]
        return pd.DataFrame(gone, columns=["child", "parent"])

    looping = own.groupBy("a").applyInPandas(acyclic, "child string, parent string")
    return taken.join(looping, ["child", "parent"], "left_anti")


class AcyclicOrder:
    """A topological order that is kept while edges come: an edge along it costs nothing, one against it a search among the
    nodes that stand between its ends, which are then put in order again."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.up: dict[str, list[str]] = {}
        self.down: dict[str, list[str]] = {}

    def _between(self, start: str, steps: dict[str, list[str]], inside: Callable[[int], bool]) -> list[str]:
        seen, todo = {start}, [start]
        while todo:
            for x in steps[todo.pop()]:
                if x not in seen and inside(self.place[x]):
                    seen.add(x)
                    todo.append(x)
        return sorted(seen, key=self.place.__getitem__)

    def add(self, child: str, parent: str) -> bool:
        """Add the edge, or leave it out and say False if it would close a loop."""
        for x in (child, parent):
            if x not in self.place:
                self.place[x], self.up[x], self.down[x] = len(self.place), [], []
        low, high = self.place[parent], self.place[child]
        if low <= high:
            above = self._between(parent, self.up, lambda i: i <= high)
            if child in above:
                return False
            below = self._between(child, self.down, lambda i: i >= low)
            moved = below + above
            for i, x in zip(sorted(self.place[x] for x in moved), moved):
                self.place[x] = i
        self.up[child].append(parent)
        self.down[parent].append(child)
        return True


def rewire_candidates(edges: DataFrame, equivalent: DataFrame, root: str) -> DataFrame:
    """parent, child, other, hop: what a merge of each equivalent edge (parent, child) of ``edges`` would rewire.

    ``other`` are the child's other parents that aren't ancestors of the parent (hop null); ``hop`` are parents of those
    that aren't either. Edges under the root are not merged. ValueError where a parent or a hop lies below the parent:
    the merge would close a loop. Reachability is that of ``edges``, which should be transitively reduced.
    """
    e = stash(edges.select("child", "parent").distinct(), "rewire-edges")
    full = stash(closure(e), "rewire-closure")
    eq = e.join(equivalent.select("child", "parent"), ["child", "parent"], "left_semi").filter(F.col("parent") != root)
    first = eq.join(e.select("child", F.col("parent").alias("other")), "child").filter("other <> parent")
    first = stash(first.select("parent", "child", "other"), "rewire-first")
    _no_loop(first, "other", full)
    free = stash(_not_above(first, "other", full), "rewire-free")
    hops = stash(free.join(e.select(F.col("child").alias("other"), F.col("parent").alias("hop")), "other").select("parent", "child", "other", "hop"), "rewire-hops")
    _no_loop(hops, "hop", full)
    return free.withColumn("hop", F.lit(None).cast("string")).unionByName(_not_above(hops, "hop", full))


def _not_above(pairs: DataFrame, column: str, full: DataFrame) -> DataFrame:
    """The pairs whose ``column`` is no ancestor of their parent."""
    above = full.select(F.col("node").alias("parent"), F.col("anc").alias(column))
    return pairs.join(above, ["parent", column], "left_anti").select(*pairs.columns)


def _no_loop(pairs: DataFrame, column: str, full: DataFrame) -> None:
    below = full.filter("node <> anc").select(F.col("anc").alias("parent"), F.col("node").alias(column))
    bad = pairs.join(below, ["parent", column], "left_semi").select("parent", "child", column).orderBy("parent", "child", column).first()
    if bad:
        raise ValueError(f"{bad[column]} lies below {bad['parent']}: merging {bad['child']} into it closes a loop")


def unpredicted(candidates: DataFrame, judgements: DataFrame) -> DataFrame:
    """child, parent: what a judge still has to answer (judgements: a, b): a candidate's parent and other parent without an
    answer, and its hops where the other parent has one."""
    j = judgements.select(F.col("a").alias("parent"), F.col("b")).distinct()
    asked = candidates.select("parent", "other").distinct()
    open_ = asked.join(j.withColumnRenamed("b", "other"), ["parent", "other"], "left_anti")
    hops = candidates.filter("hop is not null").join(j.withColumnRenamed("b", "other"), ["parent", "other"], "left_semi").select("parent", "hop").distinct()
    later = hops.join(j.withColumnRenamed("b", "hop"), ["parent", "hop"], "left_anti")
    return open_.union(later).distinct().toDF("child", "parent")


def require_predicted(candidates: DataFrame, judgements: DataFrame) -> None:
    """ValueError where a judge still has to answer for a candidate."""
    bad = unpredicted(candidates, judgements).orderBy("child", "parent").first()
    if bad:
        raise ValueError(f"no judgement on rewiring {bad['child']} to {bad['parent']} (and perhaps others)")


def valid_merges(candidates: DataFrame, judgements: DataFrame, t: float = 0.5) -> DataFrame:
    """parent, child: equivalent edges none of whose judged candidates is refused at ``t`` (judgements: a, b, ok, conf).
    Candidates without a judgement are passed over, with their hops."""
    j = judgements.select(F.col("a").alias("parent"), "b", (F.col("ok") & (F.col("conf") >= t)).alias("good"))
    own = candidates.join(j.select("parent", F.col("b").alias("other"), F.col("good").alias("good_other")), ["parent", "other"], "left")
    both = own.join(j.select("parent", F.col("b").alias("hop"), F.col("good").alias("good_hop")), ["parent", "hop"], "left")
    fine = F.when(F.col("good_other").isNull(), True).otherwise(F.col("good_other") & F.coalesce("good_hop", F.lit(True)))
    return both.groupBy("parent", "child").agg(F.bool_and(fine).alias("fine")).filter("fine").select("parent", "child")
