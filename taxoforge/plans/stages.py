"""The stages end to end: a clean class graph, summarised constraints, checked facts. Plain functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.functions.decisions import EQUIVALENT, IRRELEVANT, REVERSE
from taxoforge.operators import constraints as con
from taxoforge.operators import edits, extracts, facts, graph, ordering, votes
from taxoforge.operators.closure import closure, nodes_of, strict_closure
from taxoforge.scratch import stash


@dataclass
class Taxonomy:
    """The graph before and after the usage filter, merges, and the edit logs by stage."""

    before: DataFrame
    final: DataFrame
    mapping: DataFrame
    logs: DataFrame


def extract_taxonomy(edges: DataFrame, root: str, valid: DataFrame, metaclasses: DataFrame, described: DataFrame, counts: DataFrame, upper: DataFrame | None = None, without: tuple[str, ...] = (), keep: tuple[str, ...] = (), relink: tuple[str, ...] = ()) -> DataFrame:
    """The rules of the first stage, in their order, from raw subclass edges."""
    e = stash(ordering.rooted_extraction(edges, root, valid, metaclasses), "taxonomy")
    for top in without:
        e = stash(graph.drop_subtree(e, top), "taxonomy")
    bare = nodes_of(e).join(described.select("node"), "node", "left_anti").filter(F.col("node") != root)
    e = stash(graph.bypass(e, bare), "taxonomy")
    e = stash(graph.drop_childless_tops(e, root), "taxonomy")
    e = graph.contract(e, counts)
    if upper is not None:
        e = stash(graph.drop_upper_ontology(e, upper, root, keep, relink), "taxonomy")
    return stash(graph.drop_empty(e, counts), "taxonomy")


def _edit(edges: DataFrame, todo: DataFrame, edit: Callable[[edits.Graph, list], edits.Log], name: str) -> tuple[DataFrame, DataFrame]:
    out = stash(edits.run_edits(edges, todo, edit), "edits")
    log = out.filter("kind = 'log'").select(F.lit(name).alias("stage"), "step", "op", "child", "parent")
    return out.filter("kind = 'edge'").select("child", "parent"), log


Judged = Callable[[DataFrame], DataFrame]


def refine_taxonomy(edges: DataFrame, predictions: DataFrame, judgements: DataFrame | Judged, similarity: DataFrame, counts: DataFrame, mapped: DataFrame, root: str) -> Taxonomy:
    """Voted edits of the class graph: cut, resolve, reduce, merge, contract, drop over-specific tops, filter by usage; the
    graph is validated after each edit, and edges are put in order anew before each, as degrees have changed.

    judgements: a, b, ok, conf on rewire candidates, or what makes them from the candidates (parent, child, other, hop);
    similarity: child, parent, sim; mapped: node. ValueError where a model or a judge has left something open.
    """
    edges = stash(edges.select("child", "parent").distinct(), "refine")
    votes.require_predictions(edges, predictions)
    verdicts = stash(votes.majority(votes.conclude(predictions)), "verdicts")

    def todo(e: DataFrame, verdict: str, ascending: bool = True) -> DataFrame:
        order = ordering.order_by_similarity(ordering.edge_order(e, root), similarity, ascending)
        return order.join(verdicts.filter(F.col("verdict") == verdict).select("child", "parent"), ["child", "parent"], "left_semi").select("child", "parent", "ord")

    e, log1 = _edit(edges, todo(edges, IRRELEVANT), lambda g, o: edits.cut_irrelevant(g, o, root), "cut")
    graph.require_valid(e)
    e, log2 = _edit(e, todo(e, REVERSE), lambda g, o: edits.resolve_reversed(g, o, root, {}), "resolve")
    graph.require_valid(e)
    e = stash(graph.transitive_reduction(e), "reduced")  # as valid as before: all nodes and ways stay
    equal = stash(todo(e, EQUIVALENT, ascending=False).filter(F.col("parent") != root), "equal")
    candidates = stash(ordering.rewire_candidates(e, equal, root), "candidates")
    judged = stash(judgements(candidates) if callable(judgements) else judgements, "judged")
    ordering.require_predicted(candidates, judged)
    fine = ordering.valid_merges(candidates, judged).unionByName(equal.select("parent", "child").join(candidates, ["parent", "child"], "left_anti"))
    safe = stash(equal.join(fine, ["child", "parent"], "left_semi").select("child", "parent", "ord"), "safe")
    used = {r["parent"] for r in log2.filter("op = 'merge'").select("parent").collect()}
    e, log3 = _edit(e, safe, lambda g, o: edits.merge_equivalent(g, o, root, {}, set(used)), "merge")
    graph.require_valid(e)
    logs = stash(log1.unionByName(log2).unionByName(log3), "logs")
    mapping = stash(logs.filter("op = 'merge'").select(F.col("child").alias("src"), F.col("parent").alias("dst")), "merges")
    merged = graph.resolve_mapping(mapping)
    gone = logs.filter("op = 'delete'").select(F.col("child").alias("cls"))
    moved = counts.join(gone, "cls", "left_anti").join(merged, F.col("cls") == F.col("src"), "left").groupBy(F.coalesce("dst", "cls").alias("cls")).agg(F.sum("cnt").alias("cnt"))
    moved = stash(moved, "moved")
    e = stash(graph.contract(e, moved, reduce=True), "contracted")
    e, log4 = _edit(e, safe.limit(0), lambda g, o: edits.drop_over_specific(g, root), "tops")
    before = stash(graph.reachable_part(e, root), "before")
    final = stash(graph.filter_by_usage(before, moved, mapped, root), "final")
    graph.require_valid(final)
    return Taxonomy(before, final, mapping, stash(logs.unionByName(log4), "logs"))


def summarise_constraints(constraints: DataFrame, taxonomy: Taxonomy, counts: DataFrame, root: str) -> DataFrame:
    return con.clean_constraints(constraints, taxonomy.mapping, taxonomy.final, counts, closure(taxonomy.final), root)


def build_facts(triples: DataFrame, taxonomy: Taxonomy, constraints: DataFrame, classes: DataFrame, scholarly: DataFrame, identifiers: DataFrame, root: str) -> dict[str, DataFrame]:
    """types, type_log, facts, fact_log, check_log, constraints: from triples (s, p, o) to kept facts and used constraints."""
    t = triples
    labelled = stash(extracts.english(t, "rdfs:label").select("s").distinct(), "labelled")
    tv = stash(facts.type_verdicts(t, labelled, classes), "types")
    raw = tv.filter("verdict is null").select(F.col("s").alias("inst"), F.col("o").alias("cls"))
    re = stash(facts.retype(raw, taxonomy.before, taxonomy.final, taxonomy.mapping, root, strict_closure(taxonomy.before), strict_closure(taxonomy.final)), "retyped")
    types = re.filter("verdict is null").select("inst", "cls")
    unlabelled = tv.filter("verdict = 'instance_no_label'").select("s").distinct()
    full = stash(closure(taxonomy.final), "closure")
    fits = facts.satisfied(types, full, constraints)
    judged = stash(facts.judged_facts(t, labelled, unlabelled, scholarly, identifiers, types, constraints, fits), "facts")
    kept = judged.filter("checked = 'ok'").select("s", "p", "o")
    unused = facts.unused_types(facts.constraint_usage(kept, types, full, constraints), kept)
    return {
        "types": types,
        "type_log": tv.filter("verdict is not null").unionByName(re.filter("verdict is not null").select(F.col("inst").alias("s"), F.lit("wdt:P31").alias("p"), F.col("cls").alias("o"), "verdict")),
        "facts": kept,
        "fact_log": judged.filter("verdict <> 'kept'").select("s", "p", "o", "verdict"),
        "check_log": judged.filter("checked <> 'ok'").select("s", "p", "o", F.col("checked").alias("verdict")),
        "constraints": facts.prune_constraints(constraints, unused),
    }
