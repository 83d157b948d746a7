"""What the two viewers show, as functions that give rows or JSON; serving them is left to whoever calls."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.operators.constraints import GROUP, clean_constraints, redundant_constraints, resolve_types
from taxoforge.operators.graph import ancestor_subgraph, resolve_mapping

MOST_LABELS = 4000


class BadRequest(ValueError):
    """A parameter is missing or malformed (400)."""


class NotFound(KeyError):
    """A property or class that the data don't have (404)."""


def labelled(df: DataFrame, column: str, labels: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """df with ``column``_label: from the first table (node, label), else the second, else the id itself."""
    out = df.join(labels.select(F.col("node").alias(column), F.col("label").alias("l1")), column, "left")
    if second is not None:
        out = out.join(second.select(F.col("node").alias(column), F.col("label").alias("l2")), column, "left")
    found = F.coalesce("l1", *(["l2"] if second is not None else []), F.col(column))
    return out.withColumn(f"{column}_label", found).drop("l1", "l2")


def ask_labels(labels: DataFrame, ids: list[str]) -> DataFrame:
    """node, label of the first MOST_LABELS ids asked for."""
    bad = [x for x in ids if not re.fullmatch(r"[QP]\d+", x.strip().upper())]
    if bad:
        raise BadRequest(f"not ids: {bad[:5]}")
    asked = labels.sparkSession.createDataFrame([(x.strip().upper(),) for x in ids[:MOST_LABELS]], "node string").distinct()
    return asked.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def subgraph_rows(edges: DataFrame, labels: DataFrame, cls: str, root: str, mapping: DataFrame | None = None) -> DataFrame:
    """child, child_label, parent, parent_label, child_top: edges among a class and its ancestors."""
    part = ancestor_subgraph(edges, cls, resolve_mapping(mapping) if mapping is not None else None)
    tops = edges.filter(F.col("parent") == root).select(F.col("child").alias("top")).distinct().withColumn("hit", F.lit(True))
    out = part.join(tops, F.col("child") == F.col("top"), "left").select("child", "parent", F.coalesce("hit", F.lit(False)).alias("child_top"))
    return labelled(labelled(out, "child", labels), "parent", labels).select("child", "child_label", "parent", "parent_label", "child_top")


def taxonomy_json(edges: DataFrame, labels: DataFrame, cls: str, root: str, mapping: DataFrame | None = None) -> str:
    """The ancestor graph of a class: query with its direct superclasses, nodes by id, edges."""
    if mapping is not None:
        hit = resolve_mapping(mapping).filter(F.col("src") == cls).first()
        cls = hit["dst"] if hit else cls
    rows = subgraph_rows(edges, labels, cls, root)
    if rows.isEmpty():
        raise NotFound(cls)
    nodes = rows.select(F.col("child").alias("id"), F.col("child_label").alias("label"), F.col("child_top").alias("isTopLevel")).union(rows.select("parent", "parent_label", F.lit(False))).groupBy("id").agg(F.max("label").alias("label"), F.max("isTopLevel").alias("isTopLevel"))
    n = nodes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", F.struct("label", "isTopLevel"))))).alias("nodes"))
    e = rows.agg(F.sort_array(F.collect_list(F.struct("child", "parent"))).alias("edges"))
    q = rows.filter(F.col("child") == cls).agg(F.struct(F.lit(cls).alias("uri"), F.max("child_label").alias("label"), F.sort_array(F.collect_set("parent")).alias("directSuperclasses")).alias("query"))
    return q.crossJoin(n).crossJoin(e).select(F.to_json(F.struct("query", "nodes", "edges")).alias("json")).first()["json"]


def process_side(constraints: DataFrame, mapping: DataFrame, edges: DataFrame, counts: DataFrame, full: DataFrame, root: str) -> DataFrame:
    """property, side, type, role: what became of every type: given, merged, dropped, redundant, final."""
    nodes = full.select("node").distinct()
    kept, moved = resolve_types(constraints, mapping, nodes)
    given = constraints.select(*GROUP, "type", F.lit("given").alias("role"))
    odd = moved.select(*GROUP, "type", F.when(F.col("reason") == "merged", "merged").otherwise("dropped").alias("role"))
    less = redundant_constraints(kept, full).select(*GROUP, "type", F.lit("redundant").alias("role"))
    final = clean_constraints(constraints, mapping, edges, counts, full, root, viewer=True).select(*GROUP, "type", F.concat(F.lit("final_"), "origin").alias("role"))
    return given.unionByName(odd).unionByName(less).unionByName(final)


def summary(constraints: DataFrame, mapping: DataFrame, edges: DataFrame, counts: DataFrame, full: DataFrame, labels: DataFrame, root: str, prop: str) -> DataFrame:
    """side, type, type_label, role of one property; BadRequest for what is no property id, NotFound without constraints."""
    if not re.fullmatch(r"[A-Za-z]\w*", prop or ""):
        raise BadRequest(f"not a property: {prop!r}")
    own = constraints.filter(F.col("property") == prop)
    if own.isEmpty():
        raise NotFound(prop)
    return labelled(process_side(own, mapping, edges, counts, full, root), "type", labels).select("side", "type", "type_label", "role")


def type_strings(final: DataFrame, labels: DataFrame) -> DataFrame:
    """property, side, types: "id label" strings in order, with the number before and after."""
    named = labelled(final, "type", labels)
    return named.groupBy(*GROUP).agg(F.concat_ws("; ", F.sort_array(F.collect_set(F.concat_ws(" ", "type", "type_label")))).alias("types"), F.countDistinct("type").alias("n_types"))


def before_after(constraints: DataFrame, final: DataFrame) -> DataFrame:
    """property, side, n_before, n_after."""
    a = constraints.groupBy(*GROUP).agg(F.countDistinct("type").alias("n_before"))
    b = final.groupBy(*GROUP).agg(F.countDistinct("type").alias("n_after"))
    return a.join(b, GROUP, "left").fillna(0, ["n_after"])


def report_json(roles: DataFrame) -> str:
    """A property's summary as JSON: by side and role the types with their labels."""
    by = roles.groupBy("side", "role").agg(F.sort_array(F.collect_set(F.struct("type", "type_label"))).alias("types"))
    one = by.agg(F.sort_array(F.collect_list(F.struct("side", "role", "types"))).alias("sections"))
    return one.select(F.to_json(F.struct("sections")).alias("json")).first()["json"]


SECTIONS = [("given", "Original types"), ("dropped", "Not in the class graph"), ("redundant", "Below another allowed type"), ("final_ancestor", "Chosen common ancestors"), ("final_type", "Final types"), ("merged", "Merged types")]


def text_summary(roles: DataFrame, prop: str, label: str | None = None, metrics: DataFrame | None = None) -> str:
    """A property's summary (side, type, type_label, role) as six numbered sections, each with both sides.

    metrics, if given: side, anc, avg_distance, expansion_ratio, depth_ratio, ic_difference, shown with the ancestors.
    One property's types come to the driver, as the page that shows them needs them.
    """
    rows = [(r["side"], r["role"], r["type"], r["type_label"]) for r in roles.distinct().orderBy("side", "role", "type").collect()]
    numbers = {(r["side"], r["anc"]): r for r in metrics.collect()} if metrics is not None else {}
    lines = [f"Relation {prop}" + (f" ({label})" if label else "")]
    for i, (role, title) in enumerate(SECTIONS, 1):
        lines += ["", f"({i}) {title}"]
        for side in ("subject", "object"):
            own = [(t, name) for s, r, t, name in rows if s == side and (r == role or role == "final_type" and r == "final_ancestor")]
            lines.append(f"  [{side.capitalize()}] " + (f"{len(own)}" if own else "-"))
            for t, name in own:
                m = numbers.get((side, t)) if role == "final_ancestor" else None
                more = "  " + ", ".join(f"{k}={m[k]:.4f}" for k in ("avg_distance", "expansion_ratio", "depth_ratio", "ic_difference")) if m else ""
                lines.append(f"    {t} ({name}){more}")
    return "\n".join(lines) + "\n"


class TaxonomyViewer:
    """Ancestor graphs by model and class, as JSON, kept once made. A class that was merged is answered with the class that
    took it up, and a warning says so."""

    def __init__(self, models: dict[str, tuple[DataFrame, DataFrame]], root: str, mappings: dict[str, DataFrame] | None = None):
        self.models, self.root, self.mappings = models, root, mappings or {}
        self.kept: dict[tuple[str, str], tuple[str, str | None]] = {}

    def ask(self, model: str, cls: str) -> tuple[str, str | None]:
        """(JSON, warning or None). BadRequest for what is no id, NotFound for what isn't there."""
        if not re.fullmatch(r"[A-Za-z]\w*(:[^\s]+)?", cls or ""):
            raise BadRequest(f"not a class: {cls!r}")
        if model not in self.models:
            raise NotFound(model)
        if (model, cls) not in self.kept:
            edges, labels = self.models[model]
            mapping = self.mappings.get(model)
            hit = resolve_mapping(mapping).filter(F.col("src") == cls).first() if mapping is not None else None
            warning = f"{cls} was merged into {hit['dst']}" if hit else None
            self.kept[model, cls] = taxonomy_json(edges, labels, hit["dst"] if hit else cls, self.root), warning
        return self.kept[model, cls]


def html_tree(rows: DataFrame, root: str, most: int = 10_000) -> str:
    """Nested lists of an ancestor or descendant graph (child, child_label, parent, parent_label), from the root down;
    a class met again is a link to its first place. ValueError beyond ``most`` edges: a page is for people."""
    got = rows.orderBy("parent", "child").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} edges for a page")
    kids: dict[str, list[str]] = {}
    name = {root: root}
    for r in got:
        kids.setdefault(r["parent"], []).append(r["child"])
        name[r["parent"]], name[r["child"]] = r["parent_label"], r["child_label"]
    out, met, todo = ["<ul>"], set(), [("open", root)]
    while todo:
        what, x = todo.pop()
        if what == "close":
            out.append("</ul></li>")
        elif x in met:
            out.append(f'<li><a href="#{html.escape(x)}">{html.escape(name[x])}</a></li>')
        else:
            met.add(x)
            own = kids.get(x, [])
            out.append(f'<li id="{html.escape(x)}">{html.escape(name[x])} ({html.escape(x)})' + ("<ul>" if own else "</li>"))
            if own:
                todo.append(("close", x))
                todo += [("open", k) for k in reversed(own)]
    return "\n".join([*out, "</ul>"]) + "\n"


def svg_graph(rows: DataFrame, root: str, most: int = 2_000) -> str:
    """A drawing of such a graph: classes in layers by their distance from the root, edges as lines."""
    got = rows.orderBy("parent", "child").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} edges for a drawing")
    kids: dict[str, list[str]] = {}
    name = {root: root}
    for r in got:
        kids.setdefault(r["parent"], []).append(r["child"])
        name[r["parent"]], name[r["child"]] = r["parent_label"], r["child_label"]
    place, layer, y = {}, [root], 0
    while layer:
        for i, x in enumerate(layer):
            place[x] = (90 + 170 * i, 30 + 70 * y)
        layer, y = sorted({k for x in layer for k in kids.get(x, []) if k not in place}), y + 1
    width, height = (max(v[i] for v in place.values()) + 100 for i in (0, 1))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    for p, own in sorted(kids.items()):
        for c in own:
            if p in place and c in place:
                (x1, y1), (x2, y2) = place[p], place[c]
                out.append(f'<line x1="{x1}" y1="{y1 + 12}" x2="{x2}" y2="{y2 - 12}" stroke="gray"/>')
    for x, (cx, cy) in sorted(place.items()):
        out.append(f'<rect x="{cx - 80}" y="{cy - 12}" width="160" height="24" fill="white" stroke="black"/><text x="{cx}" y="{cy + 4}" font-size="11" text-anchor="middle">{html.escape(name[x])}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"
