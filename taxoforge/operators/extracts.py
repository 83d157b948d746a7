"""The extracts that the stages start from, as plans over triples (s, p, o) in prefixed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.functions.terms import strip_english
from taxoforge.operators.closure import descendants

# The items that the extracts ask for.
METACLASS, UPPER_ONTOLOGY, SCHOLARLY = "wd:Q19478619", "wd:Q124711104", "wd:Q13442814"
SUBJECT_CONSTRAINT, VALUE_CONSTRAINT = "wd:Q21503250", "wd:Q21510865"
TYPE, SUBCLASS, LABEL, DESCRIPTION = "wdt:P31", "wdt:P279", "rdfs:label", "schema:description"


def of(triples: DataFrame, p: str) -> DataFrame:
    return triples.filter(F.col("p") == p).select("s", "o")


def english(triples: DataFrame, p: str) -> DataFrame:
    return of(triples, p).filter(F.col("o").endswith("@en"))


def described(triples: DataFrame) -> DataFrame:
    """s: what has an English label and an English description."""
    return english(triples, LABEL).select("s").join(english(triples, DESCRIPTION).select("s"), "s", "left_semi").distinct()


def classes(triples: DataFrame) -> DataFrame:
    """cls: described classes with a superclass and a described instance."""
    d = described(triples)
    used = of(triples, TYPE).join(d, "s", "left_semi").select(F.col("o").alias("s"))
    return of(triples, SUBCLASS).select("s").distinct().join(used, "s", "left_semi").join(d, "s", "left_semi").select(F.col("s").alias("cls"))


def subclass_edges(triples: DataFrame) -> DataFrame:
    return of(triples, SUBCLASS).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()


def below(triples: DataFrame, top: str) -> DataFrame:
    """cls: a class and all below it."""
    return descendants(subclass_edges(triples), triples.sparkSession.createDataFrame([(top,)], "node string")).select(F.col("node").alias("cls")).distinct()


def metaclasses(triples: DataFrame, top: str = METACLASS) -> DataFrame:
    """inst, cls: instances of the metaclass or of a class under it."""
    return of(triples, TYPE).join(below(triples, top), F.col("o") == F.col("cls"), "left_semi").select(F.col("s").alias("inst"), F.col("o").alias("cls")).distinct()


def upper_ontology(triples: DataFrame, kind: str = UPPER_ONTOLOGY) -> DataFrame:
    """inst, name: classes of the upper ontology with their English names."""
    return of(triples, TYPE).filter(F.col("o") == kind).select("s").distinct().join(english(triples, LABEL), "s").select(F.col("s").alias("inst"), strip_english(F.col("o")).alias("name"))


def class_instance_count(triples: DataFrame) -> DataFrame:
    """cls, cnt: instances of each class with an English label."""
    return of(triples, TYPE).join(english(triples, LABEL).select(F.col("s").alias("o")).distinct(), "o", "left_semi").groupBy(F.col("o").alias("cls")).agg(F.count("*").alias("cnt"))


def external_identifiers(triples: DataFrame) -> DataFrame:
    """property, label: properties that hold external identifiers, in order."""
    ids = of(triples, "wikibase:propertyType").filter(F.col("o") == "wikibase:ExternalId").select("s").distinct()
    return ids.join(english(triples, LABEL), "s").select(F.col("s").alias("property"), strip_english(F.col("o")).alias("label")).orderBy("property", "label")


def scholarly_classes(triples: DataFrame, top: str = SCHOLARLY) -> DataFrame:
    return below(triples, top)


def type_constraints(triples: DataFrame, kind: str) -> DataFrame:
    """property, label, cls, cls_label: the types of subjects or values that statements of a constraint name, in order."""
    st = of(triples, "p:P2302").select(F.col("s").alias("property"), F.col("o").alias("st"))
    st = st.join(of(triples, "ps:P2302").filter(F.col("o") == kind).select(F.col("s").alias("st")), "st", "left_semi")
    st = st.join(of(triples, "pq:P2308").select(F.col("s").alias("st"), F.col("o").alias("cls")), "st")
    names = english(triples, LABEL).select("s", strip_english(F.col("o")).alias("name"))
    out = st.join(names.select(F.col("s").alias("property"), F.col("name").alias("label")), "property").join(names.select(F.col("s").alias("cls"), F.col("name").alias("cls_label")), "cls")
    return out.select("property", "label", "cls", "cls_label").distinct().orderBy("property", "cls")


def class_descriptions(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, labels (node, label) and descriptions (node, description) of what has a superclass and a label in English."""
    own = of(triples, SUBCLASS).select("s").distinct().join(english(triples, LABEL).select("s"), "s", "left_semi")
    edges = subclass_edges(triples).join(own.select(F.col("s").alias("child")), "child", "left_semi").select("child", "parent")
    labels = english(triples, LABEL).join(own, "s", "left_semi").select(F.col("s").alias("node"), strip_english(F.col("o")).alias("label"))
    descriptions = english(triples, DESCRIPTION).join(own, "s", "left_semi").select(F.col("s").alias("node"), strip_english(F.col("o")).alias("description"))
    return edges, labels, descriptions
