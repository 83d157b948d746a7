"""Edits and checks of a class graph, edges (child, parent), as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.operators.closure import closure, depths, descendants, nearest_kept, nodes_of, strict_closure
from taxoforge.scratch import stash

#: Layers peeled in one plan, which grows by a factor of three with each.
LAYERS = 2


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end in ``gone`` (node)."""
    g = gone.select("node").distinct()
    return edges.join(g, F.col("child") == F.col("node"), "left_anti").join(g, F.col("parent") == F.col("node"), "left_anti")


def transitive_reduction(edges: DataFrame, strict: DataFrame | None = None) -> DataFrame:
    """The least graph with the same reachability: an edge goes if another child of its parent lies above its child."""
    e = stash(edges.select("child", "parent").filter("child <> parent").distinct(), "edges")
    strict = strict if strict is not None else strict_closure(e, stored=True)
    by_way = strict.filter("node <> anc").join(e.select(F.col("child").alias("anc"), "parent"), "anc")
    return e.join(by_way.select(F.col("node").alias("child"), "parent").distinct(), ["child", "parent"], "left_anti")


def bypass(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the nodes ``gone``, their parents joined to their children; leaves among them just go."""
    kept = stash(nodes_of(edges).join(gone.select("node").distinct(), "node", "left_anti"), "kept")
    near = nearest_kept(edges, kept)
    return near.join(kept, "node", "left_semi").select(F.col("node").alias("child"), F.col("anc").alias("parent")).filter("child <> parent").distinct()


def drop_childless_tops(edges: DataFrame, root: str) -> DataFrame:
    """Without the root's children that have no child of their own."""
    inner = edges.select(F.col("parent").alias("child")).distinct()
    tops = edges.filter(F.col("parent") == root).join(inner, "child", "left_anti")
    return edges.join(tops.select("child"), "child", "left_anti")


def drop_subtree(edges: DataFrame, top: str) -> DataFrame:
    """Without the class ``top`` and all below it."""
    one = edges.sparkSession.createDataFrame([(top,)], "node string")
    return without_nodes(edges, descendants(edges, one).select("node"))


def non_informative(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """node: classes with one parent, one child and no instance of their own (counts: cls, cnt)."""
    e = edges.distinct()
    ups = e.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("ins")).filter("ins = 1")
    downs = e.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("outs")).filter("outs = 1")
    full = counts.filter("cnt >= 1").select(F.col("cls").alias("node"))
    return ups.join(downs, "node").join(full, "node", "left_anti").select("node")


def contract(edges: DataFrame, counts: DataFrame, reduce: bool = False) -> DataFrame:
    """Non-informative classes go, round by round until none is left; parent and child are joined unless a path remains."""
    e = stash(edges.select("child", "parent").distinct(), "contract")
    while True:
        gone = stash(non_informative(e, counts), "contract-nodes")
        if gone.isEmpty():
            return transitive_reduction(e) if reduce else e
        rest = without_nodes(e, gone)
        new = bypass(e, gone).join(rest, ["child", "parent"], "left_anti")
        both = stash(rest.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True))), "contract")
        lean = transitive_reduction(both)
        e = stash(both.filter("not new").select("child", "parent").unionByName(both.filter("new").select("child", "parent").join(lean, ["child", "parent"], "left_semi")), "contract")


def reachable_part(edges: DataFrame, root: str) -> DataFrame:
    """Edges whose ends the root reaches."""
    edges = stash(edges, "edges")
    there = depths(edges, root, stored=True).select("node")
    return edges.join(there.withColumnRenamed("node", "child"), "child", "left_semi").join(there.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")


def drop_upper_ontology(edges: DataFrame, upper: DataFrame, root: str, keep: tuple[str, ...] = (), relink: tuple[str, ...] = ()) -> DataFrame:
    """Without the upper classes (node) but for ``keep``; ``relink`` classes hang on the root; what it doesn't reach goes."""
    spark = edges.sparkSession
    gone = upper.select("node").filter(~F.col("node").isin(*keep, *relink, root)) if keep or relink else upper.select("node").filter(F.col("node") != root)
    links = spark.createDataFrame([(x, root) for x in relink], "child string, parent string")
    return reachable_part(without_nodes(edges, gone).select("child", "parent").unionByName(links).distinct(), root)


def cumulative_counts(counts: DataFrame, full: DataFrame) -> DataFrame:
    """cls, cum: instances of each class and all below it, every class once; full is the reflexive closure."""
    below = full.join(counts, F.col("node") == F.col("cls"), "left")
    return below.groupBy(F.col("anc").alias("cls")).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("cum"))


def drop_empty(edges: DataFrame, counts: DataFrame, skip_counted: bool = True) -> DataFrame:
    """Without classes that have no instance at or below them; with ``skip_counted`` those with a count row stay."""
    cum = cumulative_counts(counts, closure(edges)).filter("cum < 1").select(F.col("cls").alias("node"))
    if skip_counted:
        cum = cum.join(counts.select(F.col("cls").alias("node")), "node", "left_anti")
    return without_nodes(edges, cum)


def filter_by_usage(edges: DataFrame, counts: DataFrame, mapped: DataFrame, root: str, max_depth: int = 3) -> DataFrame:
    """Classes with instances that are mapped (node) or lie within ``max_depth``, each on its nearest kept ancestors."""
    some = cumulative_counts(counts, closure(edges)).filter("cum >= 1").select(F.col("cls").alias("node"))
    e = edges.join(some.withColumnRenamed("node", "child"), "child", "left_semi").join(some.withColumnRenamed("node", "parent"), "parent", "left_semi")
    e = stash(e.select("child", "parent"), "usage")
    near = depths(e, root, stored=True).filter(F.col("depth") <= max_depth).select("node")
    kept = stash(mapped.select("node").intersect(nodes_of(e)).union(near).distinct(), "usage-kept")
    linked = nearest_kept(e, kept).join(kept, "node", "left_semi").select(F.col("node").alias("child"), F.col("anc").alias("parent"))
    return transitive_reduction(linked.distinct())


def has_cycle(edges: DataFrame) -> bool:
    """Are there cycles? Edges whose child has no child, or whose parent no parent, are peeled off, LAYERS layers a round."""
    e = edges.select("child", "parent")
    n = e.count()
    while n:
        for _ in range(LAYERS):
            e = e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
            e = e.select("child", "parent")
        e = stash(e, "peeled")
        left = e.count()
        if left == n:
            return True
        n = left
    return False


def validate(edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_roots, acyclic, connected (weakly, through the one root)."""
    e = stash(edges.select("child", "parent").distinct(), "edges")
    ends = e.select(F.col("child").alias("node"), F.lit(True).alias("below")).union(e.select("parent", F.lit(False)))
    top = F.col("node").isNull() | ~F.col("below")
    nodes = ends.groupBy("node").agg(F.bool_or("below").alias("below")).agg(F.count("*").alias("n"), F.count_if(top).alias("roots"), F.min(F.when(top, F.col("node"))).alias("root")).first()
    n_nodes, n_roots = nodes["n"], nodes["roots"]
    connected = n_roots == 1 and depths(e, nodes["root"], stored=True).count() == n_nodes
    return edges.sparkSession.createDataFrame([(n_nodes, e.count(), n_roots, not has_cycle(e), connected)], "n_nodes long, n_edges long, n_roots long, acyclic boolean, connected boolean")


def require_valid(edges: DataFrame) -> DataFrame:
    """The edges, or ValueError unless they make one connected rooted acyclic graph."""
    v = validate(edges).first()
    if not (v["acyclic"] and v["connected"] and v["n_roots"] == 1):
        raise ValueError(f"not a single-rooted connected acyclic graph: {v.asDict()}")
    return edges


def ancestor_subgraph(edges: DataFrame, cls: str, mapping: DataFrame | None = None) -> DataFrame:
    """Edges among a class and its ancestors; merged classes are looked up first (mapping: src, dst, resolved)."""
    from taxoforge.operators.closure import ancestors

    if mapping is not None:
        hit = mapping.filter(F.col("src") == cls).select("dst").first()
        cls = hit["dst"] if hit else cls
    there = ancestors(edges, edges.sparkSession.createDataFrame([(cls,)], "node string")).select("node").distinct()
    return edges.join(there.withColumnRenamed("node", "child"), "child", "left_semi").join(there.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")


def descendant_subgraph(edges: DataFrame, cls: str) -> DataFrame:
    """Edges among a class and its descendants; ValueError unless they are a valid graph."""
    part = reachable_part(edges, cls)
    return require_valid(stash(part, "subgraph"))


def truncate(edges: DataFrame, root: str, depth: int = 7, without: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges down to a depth, without a subtree, and the leaves (node) at the cut."""
    e = drop_subtree(edges, without) if without else edges
    d = stash(depths(e, root), "truncate")
    inside = d.filter(F.col("depth") <= depth)
    cut = e.join(inside.select(F.col("node").alias("child")), "child", "left_semi").join(d.filter(F.col("depth") < depth).select(F.col("node").alias("parent")), "parent", "left_semi")
    return cut.select("child", "parent"), inside.join(cut.select(F.col("parent").alias("node")), "node", "left_anti").select("node")


def resolve_mapping(mapping: DataFrame) -> DataFrame:
    """src, dst: chains of merges followed to their end by doubling; the ends of a cycle are its least member."""
    m = stash(mapping.filter("src <> dst").select("src", "dst").dropDuplicates(["src"]), "mapping")
    start = m.select("src", F.col("dst").alias("end"))
    for _ in range(m.count().bit_length() + 1):
        nxt = start.select(F.col("src").alias("end"), F.col("end").alias("further"))
        moved = stash(start.join(nxt, "end", "left").select("src", F.coalesce("further", "end").alias("next"), (F.col("further").isNotNull() & (F.col("further") != F.col("end"))).alias("moved"), "end"), "mapping")
        if moved.filter("moved").isEmpty():
            break
        start = moved.select("src", F.col("next").alias("end"))
    looped = start.join(m.select(F.col("src").alias("end")), "end", "left_semi")
    fine = start.join(looped.select("src"), "src", "left_anti").select("src", F.col("end").alias("dst"))
    if looped.isEmpty():
        return fine
    ring = strict_closure(m.select(F.col("src").alias("child"), F.col("dst").alias("parent")))
    on_ring = ring.filter("node = anc").select(F.col("node").alias("anc"))
    least = ring.join(on_ring, "anc", "left_semi").groupBy(F.col("node").alias("src")).agg(F.min("anc").alias("dst"))
    return fine.unionByName(least.select("src", "dst"))


def edge_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ged, the edit distance of two graphs: nodes and edges that only one of them has. Edges lost or new with a
    node and edges that differ among shared nodes count one each."""

    def lone(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.distinct().unionAll(y.distinct()).groupBy(*x.columns).agg(F.count("*").alias("n")).filter("n = 1").agg(F.count("*").alias("n"))

    edges = lone(a.select("child", "parent"), b.select("child", "parent"))
    return lone(nodes_of(a), nodes_of(b)).unionAll(edges).agg(F.sum("n").cast("long").alias("ged"))


def exact_edit_distance(a: list[tuple[str, str]], b: list[tuple[str, str]], most: int = 12) -> int:
    """Least number of edits between two small graphs (child, parent): a node or an edge that comes or goes, a node that
    takes another's place under a new name. ValueError where more than ``most`` nodes differ: the search is exponential.

    Depth first over the nodes of the first graph, each mapped to itself, to another node or to none; what is left of the
    second graph comes new. A branch stops where its cost, with the nodes that must still come or go, is not below the best.
    """
    ea, eb = set(a), set(b)
    na, nb = sorted({x for e in ea for x in e}), sorted({x for e in eb for x in e})
    if len(set(na) ^ set(nb)) > most:
        raise ValueError(f"{len(set(na) ^ set(nb))} nodes differ, {most} at most can be searched")
    # nodes with a namesake first: mapping them to it is nearly always best, so a good bound comes early
    na.sort(key=lambda x: x not in set(nb))
    touch = {x: [e for e in ea if x in e] for x in na}
    back = {x: [e for e in eb if x in e] for x in nb}
    best = len(na) + len(nb) + len(ea) + len(eb)

    def edge_cost(x: str, y: str | None, image: dict[str, str | None], taken: dict[str, str]) -> int:
        """Edges of x, and of y, towards nodes mapped before, that have no counterpart."""
        cost = 0
        for c, p in touch[x]:
            other = p if c == x else c
            if other in image or other == x:
                ic, ip = (y if n == x else image[n] for n in (c, p))
                cost += ic is None or ip is None or (ic, ip) not in eb
        for c, p in back.get(y, ()):
            other = p if c == y else c
            if other in taken or other == y:
                oc, op = (x if n == y else taken[n] for n in (c, p))
                cost += (oc, op) not in ea
        return cost

    def go(i: int, cost: int, image: dict[str, str | None], taken: dict[str, str]) -> None:
        nonlocal best
        if cost + abs(len(na) - i - (len(nb) - len(taken))) >= best:
            return
        if i == len(na):
            left = set(nb) - set(taken)
            best = min(best, cost + len(left) + sum(1 for e in eb if e[0] in left or e[1] in left))
            return
        x = na[i]
        options = sorted((y for y in nb if y not in taken), key=lambda y: y != x)
        for y in [*options, None]:
            more = (y != x) + edge_cost(x, y, image, taken)
            image[x] = y
            if y is not None:
                taken[y] = x
            go(i + 1, cost + more, image, taken)
            del image[x]
            if y is not None:
                del taken[y]

    go(0, 0, {}, {})
    return best
