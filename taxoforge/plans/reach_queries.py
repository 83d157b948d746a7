"""Queries on reachability: labels, closures kept up under edits, components of cyclic graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoforge.operators import graph, labels, maintain, scc
from taxoforge.operators.closure import closure
from taxoforge.plans.catalog import query, sql
from taxoforge.plans.projection import kg
from taxoforge.scratch import stash

# ---- labels ------------------------------------------------------------------------------------------------------

WEIGHTS = """ends AS (SELECT child AS node, 1 AS up, 0 AS down FROM kg_noisy UNION ALL SELECT parent, 0, 1 FROM kg_noisy),
weight AS (SELECT node, (sum(up) + 1) * (sum(down) + 1) AS w FROM ends GROUP BY node),
ranked AS (SELECT node, w, row_number() OVER (ORDER BY w, node) AS r FROM weight),
held AS (SELECT c.node, c.anc, a.r AS rn, b.r AS ra, b.w AS wa, a.w AS wn FROM clo c JOIN ranked a ON a.node = c.node JOIN ranked b ON b.node = c.anc),
best AS (SELECT x.node, x.anc, max(y.ra) AS r FROM held x JOIN held y ON y.node = x.node JOIN clo z ON z.node = y.anc AND z.anc = x.anc GROUP BY x.node, x.anc)"""


@query("kg_reach_labels", sql(e="kg_noisy", more=WEIGHTS, body="""SELECT 'out' AS side, h.node AS node, h.anc AS hub, cast(h.wa AS bigint) AS w FROM held h JOIN best b ON b.node = h.node AND b.anc = h.anc AND b.r = h.ra
  UNION ALL SELECT 'in', h.anc, h.node, cast(h.wn AS bigint) FROM held h JOIN best b ON b.node = h.node AND b.anc = h.anc AND b.r = h.rn"""))
def q_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.reach_labels(kg(spark, d, "kg_noisy"))


@query("kg_has_path_labels", sql("kg_asked", e="kg_noisy", body="SELECT a.child AS child, a.parent AS parent FROM kg_asked a JOIN clo ON clo.node = a.child AND clo.anc = a.parent"))
def q_has_path(spark: SparkSession, d: str) -> DataFrame:
    return labels.has_path(kg(spark, d, "kg_asked"), stash(labels.reach_labels(kg(spark, d, "kg_noisy")), "labels"))


@query("kg_subclass_of_any_labels", sql("kg_types", "kg_constraints", body="SELECT DISTINCT k.side AS key, t.cls AS cls FROM kg_types t JOIN clo ON t.cls = clo.node JOIN kg_constraints k ON k.type = clo.anc"))
def q_subclass_labels(spark: SparkSession, d: str) -> DataFrame:
    allowed = kg(spark, d, "kg_constraints").select(F.col("side").alias("key"), F.col("type").alias("anc"))
    asked = kg(spark, d, "kg_types").select("cls").distinct().withColumn("key", F.explode(F.array(F.lit("subject"), F.lit("object"))))
    return labels.subclass_of_any(asked, stash(labels.reach_labels(kg(spark, d, "kg_edges")), "labels"), allowed)


# ---- kept up under edits -----------------------------------------------------------------------------------------


def _edited(spark: SparkSession, d: str) -> maintain.Maintained:
    edges = kg(spark, d, "kg_noisy")
    return maintain.maintain_closure(stash(closure(edges), "closure"), edges, kg(spark, d, "kg_deleted"), kg(spark, d, "kg_inserted"))


@query("kg_closure_edited", sql("kg_edited", e="kg_edited", body="SELECT node, anc, cast(dist AS bigint) AS dist FROM clo"))
def q_closure_edited(spark: SparkSession, d: str) -> DataFrame:
    return _edited(spark, d).full.select("node", "anc", F.col("dist").cast("long").alias("dist"))


@query("kg_reduction_edited", sql("kg_edited", e="kg_edited", body="SELECT e.child AS child, e.parent AS parent FROM kg_edited e WHERE NOT EXISTS (SELECT 1 FROM kg_edited x JOIN strict s ON s.anc = x.child WHERE x.parent = e.parent AND s.node = e.child AND x.child <> e.child)"))
def q_reduction_edited(spark: SparkSession, d: str) -> DataFrame:
    edges = kg(spark, d, "kg_noisy")
    m = _edited(spark, d)
    redundant = edges.join(graph.transitive_reduction(edges), ["child", "parent"], "left_anti")
    return m.edges.join(maintain.maintain_redundant(stash(redundant, "redundant"), m), ["child", "parent"], "left_anti")


# ---- components of cyclic graphs ---------------------------------------------------------------------------------


@query("kg_strong_components", sql("kg_looped", clo=False, more="walk(node, anc) AS (SELECT child, parent FROM kg_looped UNION SELECT w.node, e.parent FROM walk w JOIN kg_looped e ON e.child = w.anc)",
    body="SELECT a.node AS node, min(a.anc) AS scc FROM walk a JOIN walk b ON b.node = a.anc AND b.anc = a.node GROUP BY a.node"))
def q_components(spark: SparkSession, d: str) -> DataFrame:
    return scc.strong_components(kg(spark, d, "kg_looped"))
