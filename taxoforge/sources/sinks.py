"""Writers. Parquet is the form between stages; the text forms are for other tools."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.functions.terms import PREFIXES, escape_lines


def write_facts(facts: DataFrame, path: str, prefixes: bool = True) -> None:
    """Rows of four tab-separated fields, s, p, o and a full stop; prefix lines in a file of their own beside them."""
    facts.select(F.concat_ws("\t", "s", "p", escape_lines(F.col("o")), F.lit("."))).write.mode("overwrite").text(path)
    if prefixes:
        head = facts.sparkSession.createDataFrame([(f"@prefix {p}: <{iri}> .",) for p, iri in PREFIXES], "value string")
        head.coalesce(1).write.mode("append").text(path)


def write_rejections(rejected: DataFrame, path: str, predicate: str = "log:excludedFor") -> None:
    """The log of what was turned away: << s p o >>, the predicate that readers of the log expect, the reason."""
    cols = [F.lit("<<"), F.col("s"), F.col("p"), escape_lines(F.col("o")), F.lit(">>"), F.lit(predicate), F.col("reason"), F.lit(".")]
    rejected.select(F.concat_ws("\t", *cols)).write.mode("overwrite").text(path)


def write_split(verdicts: DataFrame, path: str) -> None:
    """Kept and rejected rows in one pass, a folder per verdict class."""
    kind = F.when(F.col("verdict").isNull() | F.col("verdict").isin("kept", "ok"), "kept").otherwise("rejected")
    verdicts.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("child", "parent").write.mode("overwrite").csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """node, tab, text in quotes."""
    name = labels.columns[1]
    labels.select(F.concat(F.col("node"), F.lit('\t"'), F.col(name), F.lit('"'))).write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    counts.select("cls", "cnt").write.mode("overwrite").option("sep", "\t").csv(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.select("src", "dst").write.mode("overwrite").csv(path)


def write_ntriples(edges: DataFrame, path: str, space: str = "http://www.wikidata.org/") -> None:
    """The class graph as N-Triples."""
    line = F.format_string(f"<{space}entity/%s> <{space}prop/direct/P279> <{space}entity/%s> .", "child", "parent")
    edges.select(line).write.mode("overwrite").text(path)


def write_constraints(constraints: DataFrame, path: str, side: str) -> None:
    """property, property_label and the side's type with its label, under a header."""
    name = "subject_type" if side == "subject" else "value_type"
    out = constraints.filter(F.col("side") == side).select("property", "property_label", F.col("type").alias(name), F.col("type_label").alias(f"{name}_label"))
    out.write.mode("overwrite").option("header", True).csv(path)


def unused_report(unused: DataFrame, labels: DataFrame) -> DataFrame:
    """relation, label, types_unused: "subject:[..], object:[..]", in order."""
    def part(side: str) -> F.Column:
        return F.concat(F.lit(f"{side}:["), F.concat_ws(", ", F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("type"))))), F.lit("]"))

    lines = unused.groupBy("property").agg(F.concat_ws(", ", part("subject"), part("object")).alias("types_unused"))
    return lines.join(labels, "property", "left").select(F.col("property").alias("relation"), F.col("property_label").alias("label"), "types_unused").orderBy("relation")


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a folder that ``df`` itself may read: write beside it, then swap."""
    spark = df.sparkSession
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(new)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    fs.delete(p(old), True)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines in the fields of the prediction files, id being parent and child."""
    predictions.select(F.concat_ws("_", "parent", "child").alias("id"), "plabel", "clabel", "original_answer", "original_answer_inverse", "answer", "confidence", "answer_inverse", "confidence_inverse").write.mode("append").json(path)


def write_distances(distances: DataFrame, path: str) -> None:
    """Edit distances of pairs of graphs as a table."""
    distances.write.mode("overwrite").parquet(path)


def text_report(row: DataFrame, title: str) -> str:
    """A one-row table as lines of name and value."""
    r = row.first()
    return "\n".join([title, *(f"{k}: {r[k]}" for k in row.columns)]) + "\n"


def turtle(triples: DataFrame) -> DataFrame:
    """value: a block of Turtle per subject, predicates and objects in order."""
    one = triples.groupBy("s", "p").agg(F.concat_ws(" , ", F.sort_array(F.collect_set("o"))).alias("os"))
    return one.groupBy("s").agg(F.concat_ws(" ;\n  ", F.sort_array(F.collect_list(F.concat_ws(" ", "p", "os")))).alias("po")).select(F.concat(F.col("s"), F.lit("\n  "), F.col("po"), F.lit(" .")).alias("value"))


