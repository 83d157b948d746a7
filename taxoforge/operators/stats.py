"""Counts and statistics over triples, classes and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxoforge.operators.closure import depths, nodes_of
from taxoforge.operators.graph import validate

# Predicates that say what an entity is called or is, not facts about it.
NO_FACTS = ["rdfs:label", "rdfs:comment", "rdf:type", "schema:url", "owl:sameAs", "schema:alternateName", "skos:altLabel", "schema:description", "skos:prefLabel"]
LABEL = "rdfs:label"


def mentions(triples: DataFrame, of: str) -> DataFrame:
    """key, n: how often each property, entity (as subject or object), class (object of a type), typed instance or
    subject is mentioned."""
    is_type = F.col("p") == "rdf:type"
    keys = {
        "property": triples.select(F.col("p").alias("key")),
        "subject": triples.select(F.col("s").alias("key")),
        "class": triples.filter(is_type).select(F.col("o").alias("key")),
        "instance": triples.filter(is_type).select(F.col("s").alias("key")),
        "entity": triples.select(F.explode(F.array("s", "o")).alias("key")),
    }
    return keys[of].groupBy("key").agg(F.count("*").alias("n"))


def facts_per_entity(triples: DataFrame, types: DataFrame) -> DataFrame:
    """entity, facts, labelled: facts of each subject beside labels and types; entities with labels or types alone have 0."""
    own = triples.groupBy(F.col("s").alias("entity")).agg(F.count_if(~F.col("p").isin(NO_FACTS)).alias("facts"), F.bool_or(F.col("p") == LABEL).alias("labelled"))
    own = own.filter("facts > 0 or labelled")
    typed = types.select(F.col("inst").alias("entity")).distinct()
    return own.join(typed, "entity", "full").select("entity", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """One row: the element at n // 2, from 0, of the sorted column. Counts by value come first, so the windows see
    distinct values only."""
    n = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v")
    run = n.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy()))
    return run.filter("upto > total div 2").agg(F.min("v").alias("median"))


def entity_summary(per_entity: DataFrame, predicates: DataFrame) -> DataFrame:
    """One row: n_entities, n_unlabelled, n_predicates, avg_facts, min_facts, max_facts, median_facts."""
    base = per_entity.agg(F.count("*").alias("n_entities"), F.count_if(~F.col("labelled")).alias("n_unlabelled"), F.avg("facts").alias("avg_facts"), F.min("facts").alias("min_facts"), F.max("facts").alias("max_facts"))
    n = predicates.agg(F.countDistinct("p").alias("n_predicates"))
    return base.crossJoin(n).crossJoin(upper_median(per_entity, "facts").withColumnRenamed("median", "median_facts"))


def fact_histogram(per_entity: DataFrame) -> DataFrame:
    return per_entity.groupBy("facts").agg(F.count("*").alias("n"))


def class_expansion(per_entity: DataFrame, types: DataFrame, full: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: avg_classes and avg_paths per entity, over all entities; classes count once an entity."""
    total = per_entity.agg(F.count("*").alias("entities"))
    # Instances of the same classes have as many above them, so a set of classes, not an instance, meets the closure.
    own = types.groupBy("inst").agg(F.sort_array(F.collect_set("cls")).alias("own")).groupBy("own").agg(F.count("*").alias("n"))
    up = own.select("own", "n", F.explode("own").alias("cls")).join(full, F.col("cls") == F.col("node"))
    wide = up.groupBy("own", "n").agg(F.count_distinct("anc").alias("above")).agg(F.coalesce(F.sum(F.col("n") * F.col("above")), F.lit(0)).alias("classes"))
    ways = types.join(paths, F.col("cls") == F.col("node")).agg(F.sum("paths").alias("paths"))
    return total.crossJoin(wide).crossJoin(ways).select((F.col("classes") / F.col("entities")).alias("avg_classes"), (F.col("paths") / F.col("entities")).alias("avg_paths"))


def weighted_paths(paths: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: root paths per class, weighted by its instances."""
    j = counts.join(paths, F.col("cls") == F.col("node"))
    return j.agg((F.sum(F.col("paths") * F.col("cnt")) / F.sum("cnt")).alias("avg_paths"))


def taxonomy_stats(edges: DataFrame, counts: DataFrame, root: str) -> DataFrame:
    """One row: n_nodes, n_edges, n_roots, acyclic, connected, n_top, n_leaves, n_internal, max_depth, n_without, avg_parents."""
    e = edges.select("child", "parent").distinct()
    nodes = nodes_of(e)
    base = validate(e)
    top = e.filter(F.col("parent") == root).agg(F.count("*").alias("n_top"))
    leaves = nodes.join(e.select(F.col("parent").alias("node")), "node", "left_anti").agg(F.count("*").alias("n_leaves"))
    deep = depths(e, root).agg(F.max("depth").alias("max_depth"))
    none = nodes.join(counts.filter("cnt > 0").select(F.col("cls").alias("node")), "node", "left_anti").agg(F.count("*").alias("n_without"))
    all_ = base.crossJoin(top).crossJoin(leaves).crossJoin(deep).crossJoin(none)
    return all_.select("*", (F.col("n_nodes") - F.col("n_leaves")).alias("n_internal"), (F.col("n_edges") / F.col("n_nodes")).alias("avg_parents"))


def constraint_stats(constraints: DataFrame) -> DataFrame:
    """One row: n_properties, avg_subject_types, avg_object_types, over the properties that either side has."""
    n = constraints.agg(F.countDistinct("property").alias("n_properties"), F.countDistinct(F.when(F.col("side") == "subject", F.struct("property", "type"))).alias("subject_types"), F.countDistinct(F.when(F.col("side") == "object", F.struct("property", "type"))).alias("object_types"))
    return n.select("n_properties", (F.col("subject_types") / F.col("n_properties")).alias("avg_subject_types"), (F.col("object_types") / F.col("n_properties")).alias("avg_object_types"))


def verdict_counts(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    return verdicts.groupBy(column).agg(F.count("*").alias("n"))
