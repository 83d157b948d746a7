"""Readers with fixed schemas for the files of a knowledge-graph dump and of the stages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxoforge.functions.terms import compact_iri, entity_id, strip_quotes, unescape
from taxoforge.sources.turtle_text import TurtleText

# A line of N-Triples: subject, predicate, object. A literal runs to the line's last quote, so that no alternative is
# tried sign by sign, however long it is.
_KIND = r'(?:@[A-Za-z0-9-]+|\^\^(?:<[^>]*>|[^\s<>"]*[^\s<>".]))?'
_BLANK = r'_:[^\s<>"]*[^\s<>".]'
_LINE = rf'(?s)^\s*(<[^>]*>|{_BLANK})\s*(<[^>]*>)\s*(<[^>]*>|{_BLANK}|".*"{_KIND})\s*\.\s*(?:#.*)?$'
#: A quote before the end of a short literal: the line's comment has quotes too.
_INNER_QUOTE = r'(?s)^"(?:"(?!"")|(?!"").*?[^\\](?:\\\\)*").*"'
_FIRST = rf'(?s)^("(?:[^"\\]|\\.)*"{_KIND})\s*\.\s*#.*$'


def iri_term(x: Column) -> Column:
    """An IRI with its prefix; blank nodes and names as they are."""
    return F.when(x.startswith("<"), compact_iri(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)


def term(x: Column) -> Column:
    """A term of N-Triples in the engine's form: IRIs with prefixes, literals, between one or three quotes, decoded."""
    parts = rf'(?s)^("""(?=.*""")|")(.*)\1({_KIND})$'
    suffix = F.regexp_extract(x, parts, 3)
    kind = F.when(suffix.startswith("^^"), F.concat(F.lit("^^"), iri_term(F.substring(suffix, F.lit(3), F.length(suffix))))).otherwise(suffix)
    literal = F.concat(F.lit('"'), unescape(F.regexp_extract(x, parts, 2)), F.lit('"'), kind)
    return F.when(x.startswith('"'), literal).otherwise(iri_term(x))


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """s, p, o, line of N-Triples lines: IRIs in prefixed form, literals decoded; lines that are neither triples nor
    comments have null s and their text in ``line``. One pattern takes a line apart; its terms are decoded one by one."""
    v = F.col(column)
    lines = lines.filter(~F.trim(v).startswith("#") & (F.trim(v) != ""))
    cut = lines.select(v.alias("line"), F.split(F.regexp_replace(v, _LINE, "\x01$1\x01$2\x01$3"), "\x01", 4).alias("ts"))
    o = F.get("ts", F.lit(3))
    o = F.when(o.startswith('"') & ~o.startswith('"""') & o.rlike(_INNER_QUOTE), F.nullif(F.regexp_extract(F.concat(o, F.lit(" . #")), _FIRST, 1), F.lit(""))).otherwise(o)
    cut = cut.select("line", "ts", F.when((F.size("ts") == 4) & (F.get("ts", F.lit(0)) == "") & ~F.col("line").startswith("\x01"), o).alias("o"))
    fine = F.col("o").isNotNull()
    s, p = (F.when(fine, iri_term(F.get("ts", F.lit(i)))) for i in (1, 2))
    # One row of an array: filters on it stay above it, where patterns would be matched once more for each.
    row = F.struct(s.alias("s"), p.alias("p"), term(F.col("o")).alias("o"), F.when(~fine, F.col("line")).alias("line"))
    return cut.select(F.explode(F.array(row)).alias("t")).select("t.*")


def read_ntriples(spark: SparkSession, path: str, predicates: list[str] | None = None) -> DataFrame:
    """s, p, o of a dump, plain or compressed; ``predicates`` (IRIs) are looked for in the raw line before it is parsed."""
    lines = spark.read.text(path)
    if predicates:
        any_of = F.lit(False)
        for iri in predicates:
            any_of = any_of | F.col("value").contains(f"<{iri}>")
        lines = lines.filter(any_of)
    return parse_ntriples(lines).filter("s is not null").select("s", "p", "o")


def read_turtle_statements(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of Turtle with one subject block up to each full stop at a line's end, with ; and , and prefixed names
    or IRIs as terms: the part of the grammar that can be read in splits. ``read_turtle`` reads all of it."""
    blocks = spark.read.option("lineSep", " .\n").text(path).select(F.trim(F.regexp_replace("value", r"(?m)^\s*(@prefix|#).*$", "")).alias("b")).filter("b <> ''")
    term = r'(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^\S+)?|[^\s;,]+|[;,])'
    terms = blocks.select(F.transform(F.regexp_extract_all("b", F.lit(term), 1), lambda x: F.when(x.startswith("<"), compact_iri(F.regexp_extract(x, "<([^>]*)>", 1))).otherwise(x)).alias("ts"))
    zero = F.struct(F.lit("").alias("p"), F.lit("").alias("last"), F.array().cast("array<struct<p:string,o:string>>").alias("out"))
    step = lambda a, x: (
        F.when(x == ";", F.struct(F.lit("").alias("p"), F.lit(";").alias("last"), a["out"].alias("out")))
        .when(x == ",", F.struct(a["p"].alias("p"), F.lit(",").alias("last"), a["out"].alias("out")))
        .when(a["p"] == "", F.struct(x.alias("p"), x.alias("last"), a["out"].alias("out")))
        .otherwise(F.struct(a["p"].alias("p"), x.alias("last"), F.concat(a["out"], F.array(F.struct(a["p"].alias("p"), x.alias("o")))).alias("out")))
    )
    own = terms.select(F.element_at("ts", 1).alias("s"), F.aggregate(F.slice("ts", F.lit(2), F.size("ts")), zero, step)["out"].alias("po"))
    return own.select("s", F.inline("po"))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of Turtle files, the whole grammar: directives, ; and , lists, bracketed blank nodes, collections, long
    strings, numbers. A file is one task's work, as its prefixes and brackets run through it; dumps come as N-Triples."""
    name = F.concat(F.lit("f"), F.lower(F.hex(F.xxhash64("_metadata.file_path"))), F.lit("x"))
    files = spark.read.text(path, wholetext=True).select("value", name.alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0), batch.column(1)):
                every = TurtleText(text.as_py(), own.as_py()).triples()
                while rows := list(islice(every, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["s", "p", "o"])

    return files.mapInArrow(run, "s string, p string, o string").select(iri_term(F.col("s")).alias("s"), iri_term(F.col("p")).alias("p"), term(F.col("o")).alias("o"))


def entity_rows(triples: DataFrame) -> DataFrame:
    """s, facts: a map of each subject's predicates to their objects, sorted."""
    by = triples.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("os"))
    return by.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "os"))).alias("facts"))


def read_tsv_triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of tab-separated rows with three fields or more; comments, prefix lines and blank lines go."""
    lines = spark.read.text(path).filter("value <> '' and not value like '#%' and not value like '@%'").select(F.split("value", "\t").alias("f"))
    return lines.filter(F.size("f") >= 3).select(*(F.element_at("f", i + 1).alias(c) for i, c in enumerate(("s", "p", "o"))))


def read_rejections(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, reason of a rejection log."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 7)
    return f.select(F.element_at("f", 2).alias("s"), F.element_at("f", 3).alias("p"), F.element_at("f", 4).alias("o"), F.element_at("f", 7).alias("reason"))


def unlabelled_instances(rejections: DataFrame) -> DataFrame:
    """s: what the type stage turned away for want of a label, in order."""
    return rejections.filter((F.col("reason") == "instance_no_label") & (F.col("p") == "wdt:P31")).select("s").distinct().orderBy("s")


def numbered(df: DataFrame) -> DataFrame:
    """What a reader gives, with its place: ``pos`` rises in reading order, files by name. A split is read by one task in
    its order, so the file, the split's place in it and the row's number in the task give the order of all rows, however
    many splits Spark packs into a task."""
    return df.withColumn("pos", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("nth")))


def read_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """child, parent: rows of exactly two fields, once each."""
    f = spark.read.text(path).select(F.split("value", sep).alias("f")).filter(F.size("f") == 2)
    return f.select(F.trim(F.element_at("f", 1)).alias("child"), F.trim(F.element_at("f", 2)).alias("parent")).distinct()


def read_edges_tsv(spark: SparkSession, path: str) -> DataFrame:
    """child, parent of the older layout, four tab-separated fields."""
    return read_tsv_triples(spark, path).select(entity_id(F.col("s")).alias("child"), entity_id(F.col("o")).alias("parent")).distinct()


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """src, dst: the last row of a source holds."""
    f = numbered(spark.read.text(path)).select(F.split("value", ",").alias("f"), "pos").filter(F.size("f") == 2)
    rows = f.select(F.trim(F.element_at("f", 1)).alias("src"), F.trim(F.element_at("f", 2)).alias("dst"), "pos")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("pos")))).filter("n = 1").select("src", "dst")


def read_labels(spark: SparkSession, path: str, name: str = "label") -> DataFrame:
    """node and its label or description: two tab-separated fields, outer quotes gone where there are two; others go."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") == 2)
    return f.select(F.element_at("f", 1).alias("node"), strip_quotes(F.element_at("f", 2)).alias(name))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: first field of CSV rows that hold an entity's IRI, without its namespace; header rows go."""
    c = F.element_at(F.split("value", ","), 1)
    return spark.read.text(path).filter(F.element_at(F.split("value", ","), 1).contains("/entity/")).select(entity_id(F.regexp_replace(c, "[<>\"]", "")).alias("id")).distinct()


def read_counts(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """cls, cnt of IRI or id and number."""
    f = spark.read.text(path).select(F.split("value", sep).alias("f")).filter(F.size("f") == 2)
    return f.select(entity_id(F.element_at("f", 1)).alias("cls"), F.trim(F.element_at("f", 2)).try_cast("bigint").alias("cnt")).filter("cnt is not null")


def read_constraints(spark: SparkSession, path: str, side: str) -> DataFrame:
    """property, property_label, side, type, type_label, pos of raw or clean constraint files; ids without namespaces;
    repeated pairs keep their first row."""
    raw = spark.read.option("header", True).csv(path)
    c = raw.columns
    f = numbered(raw).select(entity_id(F.col(c[0])).alias("property"), F.col(c[1]).alias("property_label"), F.lit(side).alias("side"), entity_id(F.col(c[2])).alias("type"), F.col(c[3]).alias("type_label"), "pos")
    return f.withColumn("n", F.row_number().over(Window.partitionBy("property", "side", "type").orderBy("pos"))).filter("n = 1").drop("n")


def all_properties(subject: DataFrame, value: DataFrame) -> DataFrame:
    """property, property_label over both files; the first label met holds, the subject file first."""
    both = subject.select("property", "property_label", F.lit(0).alias("file"), "pos").unionByName(value.select("property", "property_label", F.lit(1).alias("file"), "pos"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("property").orderBy("file", "pos"))).filter("n = 1").select("property", "property_label")


PREDICTION = "id string, plabel string, clabel string, original_answer string, original_answer_inverse string, answer string, confidence double, answer_inverse string, confidence_inverse double"


def read_predictions(spark: SparkSession, path: str, model: str, lines: bool = False) -> DataFrame:
    """Predictions of a model with parent and child apart, answers trimmed, the first of an id kept."""
    raw = numbered(spark.read.schema(PREDICTION).option("multiLine", not lines).json(path))
    first = raw.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter("n = 1")
    part = F.split("id", "_")
    return first.select(F.lit(model).alias("model"), F.element_at(part, 1).alias("parent"), F.element_at(part, 2).alias("child"), "plabel", "clabel", F.trim("answer").alias("answer"), F.trim("answer_inverse").alias("answer_inverse"), "confidence", "confidence_inverse")


def read_rewire_results(spark: SparkSession, path: str) -> DataFrame:
    """child, parent, answer, confidence of voted rewire candidates, a JSON array with child_parent ids."""
    raw = spark.read.schema("id string, answer string, confidence double").option("multiLine", True).json(path)
    part = F.split("id", "_")
    return raw.select(F.element_at(part, 1).alias("child"), F.element_at(part, 2).alias("parent"), F.trim("answer").alias("answer"), "confidence")


def read_tagged_ids(spark: SparkSession, path: str, tag: str = "[CLS]") -> DataFrame:
    """id: lines that carry a tag, without it; an empty tag reads all lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.filter(F.col("value").contains(tag)).select(F.trim(F.replace("value", F.lit(tag), F.lit("")) if tag else F.col("value")).alias("id")).distinct()


def read_wiki_mapping(spark: SparkSession, paths: list[str], nodes: DataFrame) -> DataFrame:
    """node: nodes that a wiki page stands for in one of the files (page id, item, wiki)."""
    m = spark.read.schema("page_id string, node string, wiki string").csv(paths)
    return nodes.select("node").distinct().join(m.select("node"), "node", "left_semi")


def read_usage_dump(spark: SparkSession, path: str) -> DataFrame:
    """page_id, node of an INSERT dump: tuples of four fields with an item and a description aspect; the first page of
    an item."""
    rows = numbered(spark.read.option("lineSep", ";\n").text(path).filter("value like '%INSERT INTO%'"))
    t = rows.select("pos", F.posexplode(F.regexp_extract_all("value", F.lit(r"\(([^()]*)\)"), 1)).alias("i", "t")).withColumn("f", F.split("t", ","))
    t = t.filter(F.size("f") == 4).select("pos", "i", *(F.trim(F.regexp_replace(F.element_at("f", k), "'", "")).alias(n) for k, n in ((2, "node"), (3, "aspect"), (4, "page_id"))))
    t = t.filter(F.col("node").startswith("Q") & F.col("aspect").startswith("D"))
    return t.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("pos", "i"))).filter("n = 1").select("page_id", "node")


def read_unused_types(spark: SparkSession, path: str) -> DataFrame:
    """property, side, type of the report "subject:[..], object:[..]"."""
    raw = spark.read.option("header", True).csv(path)
    return parse_unused(raw.select(F.col(raw.columns[0]).alias("property"), F.col(raw.columns[2]).alias("types_unused")))


def parse_unused(df: DataFrame) -> DataFrame:
    def side(name: str) -> Column:
        return F.transform(F.filter(F.split(F.regexp_extract("types_unused", rf"{name}:\[([^\]]*)\]", 1), ","), lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit(name).alias("side"), F.trim(F.regexp_replace(x, "'", "")).alias("type")))

    return df.select("property", F.inline(F.concat(side("subject"), side("object"))))


def read_uploaded_constraints(spark: SparkSession, path: str) -> DataFrame:
    """property, side, type, label of an uploaded JSON file; entries may be ids with labels, names or IRIs."""
    raw = spark.read.option("multiLine", True).schema("constraints array<struct<relation: string, subject_types: array<string>, object_types: array<string>>>").json(path)
    c = raw.select(F.inline("constraints"))
    both = c.select(F.col("relation").alias("relation"), F.lit("subject").alias("side"), F.explode("subject_types").alias("entry")).unionByName(c.select("relation", F.lit("object").alias("side"), F.explode("object_types").alias("entry")))
    first = F.element_at(F.split("entry", " "), 1)
    return both.select(F.regexp_replace(F.element_at(F.split("relation", "/"), -1), "^wdt:", "").alias("property"), "side", F.regexp_replace(first, "^wd:", "").alias("type"), F.nullif(F.trim(F.substring(F.col("entry"), F.length(first) + 1, F.length("entry"))), F.lit("")).alias("label"))


def list_models(spark: SparkSession, root: str, allowed: list[str] | None = None) -> list[str]:
    """Names of the folders under ``root``, on any file system, of the allowed ones."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
    return [m for m in found if allowed is None or m in allowed]
