"""Queries over files: relations are written in the forms that tools exchange and read back by the readers of those forms.

What a query returns is what the reader gave; its SQL says, from the tables alone, what that must be. Rows whose order
matters are written in order over several files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoforge.functions.decisions import answer_part, answer_word, token_confidence
from taxoforge.functions.terms import entity_id, escape_lines, normalize_literal
from taxoforge.operators import constraints as con
from taxoforge.operators import extracts, facts, graph, judge, ordering, stats, viewer, visits
from taxoforge.operators.closure import closure
from taxoforge.plans.catalog import FACTS, MERGED, SETS, TRI, WIDE, _checked, _fact_inputs, _sets, query, sql
from taxoforge.plans.projection import ROOT, kg
from taxoforge.scratch import scratch_folder, stash
from taxoforge.sources import readers, sinks, triple_source
from taxoforge.streaming.typecheck import start_two_way


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(df: DataFrame, line: Column, path: str, order: Column | None = None, header: str | None = None, **options: str) -> str:
    """Write a line per row, in order over four files if asked, below a header line of its own in the first one."""
    if order is not None:
        df = df.withColumn("o", order).repartitionByRange(4, "o").sortWithinPartitions("o")
    df.select(line.cast("string").alias("value")).write.options(**options).text(path)
    if header is not None:
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def _qid(c: str) -> Column:
    return F.concat(F.lit("Q"), F.col(c).cast("string"))


WD = "http://www.wikidata.org/entity/"

# ---- class graphs, labels, counts, mappings ----------------------------------------------------------------------


@query("kg_io_edges", sql("kg_edges", clo=False, body="SELECT child, parent FROM kg_edges"))
def q_edges(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "edges")
    e = kg(spark, d, "kg_edges")
    sinks.write_edges(e.unionByName(e.limit(20)), path)
    return readers.read_edges(spark, path)


@query("kg_io_edges_tsv", "SELECT concat('Q', cast(n_nationkey AS varchar)) AS child, concat('R', cast(n_regionkey AS varchar)) AS parent FROM nation")
def q_edges_tsv(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", F.concat(F.lit("wd:q"), "n_nationkey"), F.lit("rdfs:subClassOf"), F.concat(F.lit(f"{WD}R"), "n_regionkey"), F.lit("."))
    path = _lines(_table(spark, d, "nation"), line, scratch_folder(spark, "edges-tsv"), header="@prefix wd: <x> .")
    return readers.read_edges_tsv(spark, path)


@query("kg_io_labels", sql("kg_labels", clo=False, body="SELECT node, label FROM kg_labels"))
def q_labels(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "labels")
    sinks.write_labels(kg(spark, d, "kg_labels"), path)
    return readers.read_labels(spark, path)


@query("kg_io_counts", "SELECT concat('Q', cast(c_nationkey AS varchar)) AS cls, count(*) AS cnt FROM customer GROUP BY 1")
def q_counts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "counts")
    sinks.write_counts(_table(spark, d, "customer").groupBy(_qid("c_nationkey").alias("cls")).agg(F.count("*").alias("cnt")), path)
    return readers.read_counts(spark, path, sep="\t")


@query("kg_io_mapping", "SELECT concat('Q', cast(c_custkey % 97 AS varchar)) AS src, concat('Q', cast(max(c_custkey) * 7 AS varchar)) AS dst FROM customer GROUP BY c_custkey % 97")
def q_mapping_file(spark: SparkSession, d: str) -> DataFrame:
    """Of several lines for one source the last holds."""
    line = F.concat(F.lit("Q"), F.col("c_custkey") % 97, F.lit(",Q"), F.col("c_custkey") * 7)
    return readers.read_mapping(spark, _lines(_table(spark, d, "customer"), line, scratch_folder(spark, "mapping"), F.col("c_custkey")))


@query("kg_io_mapping_written", sql("kg_mapping", clo=False, body="SELECT src, dst FROM kg_mapping"))
def q_mapping_written(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "mapping")
    sinks.write_mapping(kg(spark, d, "kg_mapping"), path)
    return readers.read_mapping(spark, path)


@query("kg_io_ids", "SELECT DISTINCT concat('Q', cast(o_custkey AS varchar)) AS id FROM orders")
def q_ids(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit(f"<{WD}Q"), "o_custkey", F.lit(">,order "), "o_orderkey")
    return readers.read_ids(spark, _lines(_table(spark, d, "orders"), line, scratch_folder(spark, "ids"), header="item,itemLabel"))


@query("kg_io_tagged_ids", "SELECT DISTINCT concat('Q', cast(c_custkey AS varchar)) AS id FROM customer WHERE c_custkey % 3 = 0")
def q_tagged(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(_qid("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, " [CLS]").otherwise(""))
    return readers.read_tagged_ids(spark, _lines(_table(spark, d, "customer"), line, scratch_folder(spark, "tags")))


@query("kg_io_wiki_mapping", "SELECT concat('Q', cast(c_custkey AS varchar)) AS node FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def q_wiki(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").withColumn("node", _qid("c_custkey"))
    paths = []
    for wiki, n in (("enwiki", 5), ("frwiki", 7)):
        paths.append(_lines(c.filter(F.col("c_custkey") % n == 0), F.concat(F.col("c_custkey") + 1000, F.lit(","), "node", F.lit(f",{wiki}")), scratch_folder(spark, wiki)))
    return readers.read_wiki_mapping(spark, paths, c.select("node"))


@query("kg_io_usage_dump", "SELECT concat('Q', cast(c_custkey % 211 AS varchar)) AS node, cast(min(c_custkey) AS varchar) AS page_id FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_custkey % 211")
def q_usage_dump(spark: SparkSession, d: str) -> DataFrame:
    """Tuples of ten customers a statement, in order; those with another aspect than a description go."""
    k = F.col("c_custkey")
    one = F.concat(F.lit("("), k + 5, F.lit(",'Q"), k % 211, F.lit("','"), F.when(k % 3 == 0, "S").otherwise("D.en"), F.lit("',"), k, F.lit(")"))
    rows = _table(spark, d, "customer").groupBy((k / 10).cast("long").alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", one.alias("t")))), lambda x: x["t"]), ",").alias("ts"))
    path = _lines(rows, F.concat(F.lit("INSERT INTO `u` VALUES "), "ts", F.lit(";")), scratch_folder(spark, "dump"), F.col("g"))
    return readers.read_usage_dump(spark, path)


@query("kg_io_models", """WITH m AS (SELECT r_name, min(r_regionkey) AS k, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT r_name AS model, n AS edges FROM m WHERE k % 2 = 0""")
def q_models(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each region's edges; of the folders found those of the asked models, with their numbers of edges."""
    root = scratch_folder(spark, "models")
    named = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.col("r_name").alias("model")).write.partitionBy("model").parquet(f"{root}/all")
    asked = [f"model={r['r_name'].replace(' ', '%20')}" for r in _table(spark, d, "region").filter("r_regionkey % 2 = 0").orderBy("r_name").collect()]
    found = readers.list_models(spark, f"{root}/all", [*asked, *(x.replace("%20", " ") for x in asked), "model=none"])
    edges = spark.read.option("basePath", f"{root}/all").parquet(*(f"{root}/all/{m}" for m in found))
    return edges.groupBy("model").agg(F.count("*").alias("edges"))


# ---- triples -----------------------------------------------------------------------------------------------------

TEXTS = "SELECT s, p, o FROM kg_triples UNION ALL SELECT concat('wd:Q', cast(doc_id AS varchar)), 'schema:text', concat('\"', {text}, '\"@', lang) FROM documents"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    more = _table(spark, d, "documents").select(F.concat(F.lit("wd:"), _qid("doc_id")).alias("s"), F.lit("schema:text").alias("p"), F.concat(F.lit('"'), "text", F.lit('"@'), "lang").alias("o"))
    return kg(spark, d, TRI).unionByName(more)


@query("kg_io_facts", sql(TRI, clo=False, body=TEXTS.format(text="replace(replace(replace(text, chr(13), ''), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't')")))
def q_facts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts too: a row stays a line of four fields, whatever its literal holds."""
    path = scratch_folder(spark, "facts")
    sinks.write_facts(_texts(spark, d), path)
    return readers.read_tsv_triples(spark, path)


NAMED = "named AS (SELECT DISTINCT s FROM kg_triples WHERE p = 'rdfs:label' AND o LIKE '%@en')"


@query("kg_io_rejections", sql(TRI, clo=False, more=NAMED, body="SELECT DISTINCT s FROM kg_triples WHERE s NOT IN (SELECT s FROM named)"))
def q_rejections(spark: SparkSession, d: str) -> DataFrame:
    t = kg(spark, d, TRI)
    classes = spark.createDataFrame([("wd:Q900",), ("wd:Q901",)], "cls string")
    path = scratch_folder(spark, "rejected")
    sinks.write_rejections(facts.type_verdicts(t, extracts.english(t, "rdfs:label").select("s"), classes).filter("verdict is not null").withColumnRenamed("verdict", "reason"), path)
    return readers.unlabelled_instances(readers.read_rejections(spark, path))


@query("kg_io_split", sql(TRI, clo=False, more=FACTS, body="SELECT CASE WHEN verdict = 'kept' THEN 'kept' ELSE 'rejected' END AS kind, verdict, count(*) AS n FROM fv GROUP BY 1, 2"))
def q_split(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "split")
    sinks.write_split(facts.fact_verdicts(*_fact_inputs(spark, d)), path)
    return spark.read.parquet(path).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@query("kg_io_ntriples", "SELECT concat('wd:Q', cast(n_nationkey AS varchar)) AS s, 'wdt:P279' AS p, concat('wd:Q', cast(1000 + n_regionkey AS varchar)) AS o FROM nation")
def q_ntriples(spark: SparkSession, d: str) -> DataFrame:
    """A compressed dump with comments and other predicates, read for one predicate."""
    n = _table(spark, d, "nation")
    path = scratch_folder(spark, "nt")
    sinks.write_ntriples(n.select(_qid("n_nationkey").alias("child"), F.concat(F.lit("Q"), F.col("n_regionkey") + 1000).alias("parent")), f"{path}/a")
    other = F.concat(F.lit(f"<{WD}Q"), "n_nationkey", F.lit('> <http://www.w3.org/2000/01/rdf-schema#label> "'), "n_name", F.lit('"@en . # a <name>'))
    _lines(n, other, f"{path}/b", compression="gzip")
    _lines(n.limit(3), F.lit("# a comment, <http://www.wikidata.org/prop/direct/P279> in it"), f"{path}/c")
    return readers.read_ntriples(spark, [f"{path}/a", f"{path}/b", f"{path}/c"], ["http://www.wikidata.org/prop/direct/P279"])


PART_NT = """nt AS (SELECT concat('wd:Q', cast(p_partkey AS varchar)) AS s, 'wdt:P31' AS p, concat('wd:B', cast(p_size AS varchar)) AS o FROM part
  UNION ALL SELECT concat('wd:Q', cast(p_partkey AS varchar)), 'rdfs:label', concat('"', p_name, ' é"@en') FROM part)"""


def _part_lines(spark: SparkSession, d: str) -> str:
    """Part as N-Triples in several files, one compressed, with other predicates, comments, broken and empty lines."""
    part = _table(spark, d, "part")
    s = F.concat(F.lit(f"<{WD}Q"), "p_partkey", F.lit("> "))
    path = scratch_folder(spark, "triples")
    kind = F.concat(s, F.lit(f"<http://www.wikidata.org/prop/direct/P31> <{WD}B"), "p_size", F.lit("> ."))
    label = F.concat(s, F.lit('<http://www.w3.org/2000/01/rdf-schema#label> "'), "p_name", F.lit(' \\u00e9"@en . # <a> <b> <c>'))
    other = F.concat(s, F.lit('<http://schema.org/name> "'), "p_name", F.lit('" .'))
    _lines(part, F.concat_ws("\n", kind, F.lit("# a comment"), other, F.lit("")), f"{path}/a")
    _lines(part, F.concat_ws("\n", F.lit("broken <line"), label), f"{path}/b", compression="gzip")
    return path


@query("kg_io_source", "WITH " + PART_NT + " SELECT s, p, o FROM nt")
def q_source(spark: SparkSession, d: str) -> DataFrame:
    """A dump through the source of its own: two predicates, asked for as a filter."""
    triple_source.register(spark)
    lines = spark.read.format("ntriples").option("splitBytes", 4096).load(_part_lines(spark, d))
    return triple_source.triples(lines.filter(F.col("p").isin("wdt:P31", "rdfs:label")))


@query("kg_io_source_stream", "WITH " + PART_NT + " SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM nt GROUP BY p UNION ALL SELECT NULL, count(*), 1 FROM part")
def q_source_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same reader on a stream of the dump's files; broken lines are counted too."""
    triple_source.register(spark)
    lines = spark.readStream.format("ntriples").load(_part_lines(spark, d))
    root = scratch_folder(spark, "triple-stream")
    q = lines.writeStream.format("parquet").option("checkpointLocation", f"{root}/log").start(f"{root}/lines")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.schema(triple_source.SCHEMA).parquet(f"{root}/lines")
    wanted = got.filter("p is null or p in ('wdt:P31', 'rdfs:label')")
    return wanted.withColumn("s", F.when(F.col("p").isNotNull(), F.split("value", " ")[0]).otherwise("")).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query("kg_io_turtle", sql(TRI, clo=False, body="SELECT DISTINCT s, p, o FROM kg_triples"))
def q_turtle_file(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_turtle(spark, _lines(sinks.turtle(kg(spark, d, TRI)), F.col("value"), scratch_folder(spark, "ttl")))


@query("kg_io_turtle_splits", sql(TRI, clo=False, body="SELECT DISTINCT s, p, o FROM kg_triples"))
def q_turtle_splits(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_turtle_statements(spark, _lines(sinks.turtle(kg(spark, d, TRI)), F.col("value"), scratch_folder(spark, "ttl")))


@query("kg_entity_rows", sql(TRI, clo=False, body="SELECT s, p, string_agg(DISTINCT o, ' | ' ORDER BY o) AS os FROM kg_triples GROUP BY s, p"))
def q_entity_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.entity_rows(kg(spark, d, TRI)).select("s", F.explode("facts").alias("p", "o")).select("s", "p", F.array_join("o", " | ").alias("os"))


@query("kg_keep_predicates", sql(TRI, clo=False, body="SELECT s, p, o FROM kg_triples WHERE p IN ('wdt:P31', 'wdt:P407', 'rdfs:label')"))
def q_keep(spark: SparkSession, d: str) -> DataFrame:
    return facts.keep_predicates(kg(spark, d, TRI), ["wdt:P31", "wdt:P407", "rdfs:label"])


@query("kg_literal_forms", "SELECT doc_id AS id, replace(replace(replace(text, chr(13), ''), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') AS one_line, concat('\"', replace(text, chr(65533), ''), '\"@lzh') AS standard, concat('Q', cast(doc_id AS varchar)) AS entity FROM documents")
def q_literal_forms(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    old = F.concat(F.lit('"�'), "text", F.lit('"@zh-classical'))
    return docs.select(F.col("doc_id").alias("id"), escape_lines(F.col("text")).alias("one_line"), normalize_literal(old).alias("standard"), entity_id(F.concat(F.lit(f" {WD}q"), "doc_id", F.lit(" "))).alias("entity"))


class _Census:
    """Predicates and facts of each entity; at the end how many entities the task saw."""

    def __init__(self) -> None:
        self.seen = 0

    def visit(self, subject: str, own: dict[str, list[str]]) -> list[tuple]:
        self.seen += 1
        return [(subject, len(own), sum(map(len, own.values())), 0)]

    def result(self) -> list[tuple]:
        return [(None, 0, 0, self.seen)]


@query("kg_entity_visits", sql(TRI, clo=False, more="t AS (SELECT DISTINCT s, p, o FROM kg_triples)", body="SELECT s, count(DISTINCT p) AS n_predicates, count(*) AS n_facts, cast(0 AS bigint) AS n_seen FROM t GROUP BY s UNION ALL SELECT NULL, 0, 0, count(DISTINCT s) FROM t"))
def q_visits(spark: SparkSession, d: str) -> DataFrame:
    got = visits.visit_entities(kg(spark, d, TRI), _Census, "s string, n_predicates long, n_facts long, n_seen long")
    return got.groupBy("s").agg(*(F.sum(c).alias(c) for c in ("n_predicates", "n_facts", "n_seen")))


class _Degree:
    def visit(self, subject: str, facts: dict[str, list[str]]) -> list[tuple]:
        return [(subject, len(facts), sum(map(len, facts.values())))]

    def result(self) -> list[tuple]:
        return []


class _Predicates:
    def visit(self, subject: str, facts: dict[str, list[str]]) -> list[tuple]:
        return [(subject, p, os[0]) for p, os in facts.items()]

    def result(self) -> list[tuple]:
        return []


@query("kg_entity_function", sql(TRI, clo=False, more="t AS (SELECT DISTINCT s, p, o FROM kg_triples)", body="""SELECT a.s AS s, n_predicates, n_facts, f.p AS p, f.o AS first_o
  FROM (SELECT s, count(DISTINCT p) AS n_predicates, count(*) AS n_facts FROM t GROUP BY s) a JOIN (SELECT s, p, min(o) AS o FROM t GROUP BY s, p) f ON f.s = a.s"""))
def q_entity_function(spark: SparkSession, d: str) -> DataFrame:
    """Two visitors called from SQL, whose rows have different schemas."""
    function = visits.entity_function({"degree": (_Degree, "s string, n_predicates long, n_facts long"), "predicates": (_Predicates, "s string, p string, o string")})
    spark.udtf.register("visit_entities", function)
    t = stash(kg(spark, d, TRI), "visited")
    t.unionByName(t.limit(50)).createOrReplaceTempView("taxoforge_visited")
    return spark.sql("""SELECT a.s, a.n_predicates, a.n_facts, f.p, f.o AS first_o FROM visit_entities(TABLE(taxoforge_visited), 'degree') a
        JOIN visit_entities(TABLE(taxoforge_visited), 'predicates') f ON f.s = a.s""")


@query("kg_line_keys", "SELECT key, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS key FROM conversations) x GROUP BY key")
def q_line_keys(spark: SparkSession, d: str) -> DataFrame:
    return visits.count_keys(_table(spark, d, "conversations"), lambda line: F.split(line, " "), "text")


# ---- constraints, predictions ------------------------------------------------------------------------------------

ROWS = "rows AS (SELECT concat('P', cast(o_orderkey % 7 AS varchar)) AS property, concat('Q', cast(o_custkey % 50 AS varchar)) AS type, o_orderkey AS pos FROM orders)"


def _constraint_rows(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders")
    rows = o.select(F.concat(F.lit("P"), F.col("o_orderkey") % 7).alias("property"), F.concat(F.lit("property "), "o_orderkey").alias("property_label"), F.lit("subject").alias("side"), F.concat(F.lit("Q"), F.col("o_custkey") % 50).alias("type"), F.concat(F.lit("type "), "o_orderkey").alias("type_label"), F.col("o_orderkey").alias("o"))
    return rows.repartitionByRange(4, "o").sortWithinPartitions("o")


@query("kg_io_constraints", "WITH " + ROWS + " SELECT property, concat('property ', cast(min(pos) AS varchar)) AS property_label, 'subject' AS side, type, concat('type ', cast(min(pos) AS varchar)) AS type_label FROM rows GROUP BY property, type")
def q_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Repeated pairs keep their first row."""
    path = scratch_folder(spark, "constraints")
    sinks.write_constraints(_constraint_rows(spark, d), path, "subject")
    return readers.read_constraints(spark, path, "subject").drop("pos")


@query("kg_io_properties", "WITH " + ROWS + " SELECT property, concat('property ', cast(min(pos) AS varchar)) AS property_label FROM rows GROUP BY property UNION ALL SELECT 'P9', 'only values'")
def q_properties(spark: SparkSession, d: str) -> DataFrame:
    one, two = scratch_folder(spark, "subjects"), scratch_folder(spark, "values")
    rows = _constraint_rows(spark, d)
    sinks.write_constraints(rows, one, "subject")
    value = rows.select("property", F.lit("later").alias("property_label"), F.lit("object").alias("side"), "type", "type_label")
    sinks.write_constraints(value.unionByName(spark.createDataFrame([("P9", "only values", "object", "Q1", "x")], value.schema)), two, "object")
    return readers.all_properties(readers.read_constraints(spark, one, "subject"), readers.read_constraints(spark, two, "object"))


@query("kg_io_unused", sql("kg_constraints", clo=False, more=WIDE, body="SELECT property, side, type FROM wide"))
def q_unused_file(spark: SparkSession, d: str) -> DataFrame:
    more = spark.createDataFrame([("bought", "object", "TB:NONE:Brand#0"), ("bought", "subject", "C:supplier")], "property string, side string, type string")
    path = scratch_folder(spark, "unused")
    labels = spark.createDataFrame([("bought", "has, bought")], "property string, property_label string")
    sinks.unused_report(kg(spark, d, "kg_constraints").unionByName(more), labels).write.option("header", True).csv(path)
    return readers.read_unused_types(spark, path)


@query("kg_io_predictions", sql("kg_predictions", clo=False, body="SELECT 'm1' AS model, parent, child, plabel, clabel, answer, answer_inverse, confidence, confidence_inverse FROM kg_predictions WHERE model = 'm1'"))
def q_predictions_file(spark: SparkSession, d: str) -> DataFrame:
    """Of predictions with one id the first holds; answers lose the blanks around them."""
    p = kg(spark, d, "kg_predictions").filter("model = 'm1'").withColumn("nth", F.lit(0)).withColumn("answer", F.concat(F.lit(" "), "answer", F.lit(" ")))
    both = p.unionByName(p.withColumn("answer", F.lit("Changed")).withColumn("nth", F.lit(1)))
    both = both.withColumn("original_answer", F.lit("a")).withColumn("original_answer_inverse", F.lit("b"))
    path = scratch_folder(spark, "predictions")
    sinks.write_predictions(both.repartitionByRange(5, "nth", "child", "parent").sortWithinPartitions("nth", "child", "parent"), path)
    return readers.read_predictions(spark, path, "m1", lines=True)


@query("kg_io_rewire", "SELECT concat('Q', cast(n_nationkey AS varchar)) AS child, concat('Q', cast(n_regionkey + 100 AS varchar)) AS parent, CASE WHEN n_nationkey % 2 = 0 THEN 'True' ELSE 'False' END AS answer, cast(n_nationkey AS double) / 32 AS confidence FROM nation")
def q_rewire_file(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    one = F.struct(F.concat(F.lit("Q"), k, F.lit("_Q"), F.col("n_regionkey") + 100).alias("id"), F.when(k % 2 == 0, " True").otherwise("False ").alias("answer"), (k / 32).alias("confidence"))
    array = _table(spark, d, "nation").agg(F.to_json(F.collect_list(one)).alias("v"))
    return readers.read_rewire_results(spark, _lines(array, F.col("v"), scratch_folder(spark, "rewire")))


@query("kg_io_uploaded", "SELECT concat('P', cast(n_nationkey AS varchar)) AS property, 'subject' AS side, concat('Q', cast(n_regionkey AS varchar)) AS type, lower(n_name) AS label FROM nation UNION ALL SELECT concat('P', cast(n_nationkey AS varchar)), 'object', 'schema:Thing', NULL FROM nation")
def q_uploaded(spark: SparkSession, d: str) -> DataFrame:
    """Relations as IRIs or names, types as ids with labels or as names."""
    k = F.col("n_nationkey")
    relation = F.when(k % 2 == 0, F.concat(F.lit("http://www.wikidata.org/prop/direct/P"), k)).otherwise(F.concat(F.lit("wdt:P"), k))
    one = F.struct(relation.alias("relation"), F.array(F.concat(F.lit("wd:Q"), "n_regionkey", F.lit(" "), F.lower("n_name"))).alias("subject_types"), F.array(F.lit("schema:Thing")).alias("object_types"))
    whole = _table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(one).alias("constraints"))).alias("v"))
    return readers.read_uploaded_constraints(spark, _lines(whole, F.col("v"), scratch_folder(spark, "upload")))


@query("kg_io_distance", "SELECT 'core' AS model_a, 'lean' AS model_b, 2 * count(*) AS ged FROM nation WHERE n_regionkey = 1")
def q_distance_file(spark: SparkSession, d: str) -> DataFrame:
    """A region's nations are lost with an edge each."""
    e = kg(spark, d, "kg_edges")
    path = scratch_folder(spark, "distances")
    sinks.write_distances(graph.edge_difference(e, e.filter("parent <> 'R:1'")).select(F.lit("core").alias("model_a"), F.lit("lean").alias("model_b"), "ged"), path)
    return spark.read.parquet(path)


@query("kg_io_replaced", sql("kg_constraints", clo=False, body="SELECT property, side, type FROM kg_constraints WHERE side = 'subject'"))
def q_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A table overwritten by what was read from it."""
    path = scratch_folder(spark, "replaced")
    kg(spark, d, "kg_constraints").write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).filter("side = 'subject'"), path)
    return spark.read.parquet(path)


@query("kg_text_report", sql("kg_constraints", clo=False, body="""SELECT unnest(['Constraints', concat('n_properties: ', cast(count(DISTINCT property) AS varchar)), concat('avg_subject_types: ', cast(count(*) FILTER (side = 'subject') / cast(count(DISTINCT property) AS double) AS varchar)),
  concat('avg_object_types: ', cast(count(*) FILTER (side = 'object') / cast(count(DISTINCT property) AS double) AS varchar))]) AS line FROM kg_constraints"""))
def q_text_report(spark: SparkSession, d: str) -> DataFrame:
    text = sinks.text_report(stats.constraint_stats(kg(spark, d, "kg_constraints")), "Constraints")
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


# ---- vectors, judges, viewer -------------------------------------------------------------------------------------


@query("kg_edge_similarity", "SELECT c.vec_id AS child, p.vec_id AS parent, round(list_dot_product(cast(c.embedding AS double[]), cast(p.embedding AS double[])), 6) AS sim FROM embeddings c JOIN embeddings p ON p.vec_id = c.vec_id // 3")
def q_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = kg(spark, d, "kg_vectors").select("node", "vec")
    return ordering.edge_similarity(v.select(F.col("node").alias("child"), F.expr("node div 3").alias("parent")), v).select("child", "parent", F.round("sim", 6).alias("sim"))


@query("kg_missing_vectors", "SELECT DISTINCT o_custkey AS node FROM orders WHERE o_custkey NOT IN (SELECT vec_id FROM embeddings)")
def q_missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return ordering.missing_nodes(_table(spark, d, "orders").select(F.col("o_custkey").alias("node")).distinct(), kg(spark, d, "kg_vectors"))


PROMPT = "concat('The entity is ', n_name, '.', chr(10), 'Is it one?')"


@query("kg_chat_messages", f"""SELECT n_nationkey AS id, 'plain' AS family, 1 AS place, 'user' AS role, {PROMPT} AS content FROM nation
UNION ALL SELECT n_nationkey, 'system', 1, 'system', 'You are an ontological expert in hierarchical concept analysis.' FROM nation UNION ALL SELECT n_nationkey, 'system', 2, 'user', {PROMPT} FROM nation
UNION ALL SELECT n_nationkey, 'parts', 1, 'system', cast(to_json([{{'type': 'text', 'text': 'You are an ontological expert in hierarchical concept analysis.'}}]) AS varchar) FROM nation UNION ALL SELECT n_nationkey, 'parts', 2, 'user', cast(to_json([{{'type': 'text', 'text': {PROMPT}}}]) AS varchar) FROM nation""")
def q_messages(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("The entity is "), "n_name", F.lit(".\nIs it one?"))
    n = _table(spark, d, "nation")
    out = None
    for family in ("plain", "system", "parts"):
        one = n.select(F.col("n_nationkey").alias("id"), F.lit(family).alias("family"), F.posexplode(judge.messages(text, family)).alias("place", "m")).select("id", "family", (F.col("place") + 1).alias("place"), "m.role", "m.content")
        out = one if out is None else out.unionByName(one)
    return out


@query("kg_type_prompts", "SELECT n_nationkey AS id, concat('*', n_name, '* is/are described as \"a nation {x}\". [region ', cast(n_regionkey AS varchar), '] is/are described as \"a region\".') AS context, concat('*', n_name, '* is a/an [region ', cast(n_regionkey AS varchar), '].') AS statement, 3 AS examples FROM nation")
def q_type_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The judge's second question filled in: its last context and statement, and how many examples come before."""
    text = judge.prompt(F.col("n_name"), F.lit("a nation {x}"), F.concat(F.lit("region "), "n_regionkey"), F.lit("a region"), judge.TYPE_TEMPLATE)
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), text.alias("t"))
    last = lambda word: F.element_at(F.split(F.element_at(F.split("t", f"\n{word}: "), -1), "\n"), 1)
    return n.select("id", last("context").alias("context"), last("type statement").alias("statement"), (F.size(F.split("t", "\ncontext: ")) - 2).alias("examples"))


def _longer_name(generation: judge.Generation) -> judge.Judge:
    """A judge that holds the longer of two names for the subclass."""

    def answer(talks: list[list[dict]]) -> list[tuple[str, float]]:
        names = [re.search(r"Is '(.*)' a subclass of '(.*)'\?", t[-1]["content"]).groups() for t in talks]
        return [(f"**Answer: {len(a) > len(b)}**", 0.5) for a, b in names]

    return answer


@query("kg_judges", """SELECT 'longer' AS judge, n_name AS child, r_name AS parent, CASE WHEN length(n_name) > length(r_name) THEN 'True' ELSE 'False' END AS answer,
  CASE WHEN length(r_name) > length(n_name) THEN 'True' ELSE 'False' END AS answer_inverse FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_judges(spark: SparkSession, d: str) -> DataFrame:
    """A judge that joins the registry and is asked by its name about all nations and their regions."""
    judge.register_judge("longer", _longer_name)
    named = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = named.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.col("n_name").alias("clabel"), F.lit("a nation").alias("cdesc"), F.col("r_name").alias("plabel"), F.lit("a region").alias("pdesc"))
    said = [judge.judge_edges(asked, name, model=name) for name in judge.known_judges() if name == "longer"]
    return said[0].select(F.col("model").alias("judge"), "child", "parent", "answer", "answer_inverse")



@query("kg_token_confidence", sql("kg_answers", clo=False, more="t AS (SELECT id, string_split(answer, ' ') AS ts, list_filter(string_split(answer, ' '), lambda x: regexp_matches(lower(x), 'true|false|yes|no')) AS said FROM kg_answers)", body="SELECT id, round(CASE WHEN len(said) > 0 THEN 1.0 / list_position(ts, said[1]) ELSE 0.0 END, 6) AS confidence FROM t"))
def q_token_confidence(spark: SparkSession, d: str) -> DataFrame:
    a = kg(spark, d, "kg_answers").select("id", "answer", F.split("answer", " ").alias("ts"))
    odds = F.transform("ts", lambda x, i: 1 / (i + 1))
    return a.select("id", F.round(token_confidence(F.col("ts"), F.col("ts"), odds, answer_word(answer_part(F.col("answer")))), 6).alias("confidence"))


@query("kg_ask_labels", sql(clo=False, body="SELECT concat('Q', cast(i AS varchar)) AS node, coalesce(lower(n_name), concat('Q', cast(i AS varchar))) AS label FROM range(4000) t(i) LEFT JOIN nation ON n_nationkey = i"))
def q_ask_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first 4,000 of 5,000 ids asked for."""
    labels = _table(spark, d, "nation").select(_qid("n_nationkey").alias("node"), F.lower("n_name").alias("label"))
    return viewer.ask_labels(labels, [f"Q{i}" for i in range(5000)])


ROLES = SETS + ", " + MERGED + """,
tg AS (SELECT property, side, type, coalesce(dst, type) AS target FROM sets LEFT JOIN mp ON src = type), fin AS (SELECT DISTINCT property, side, target AS type FROM tg WHERE target IN (SELECT node FROM nodes)),
roles AS (SELECT property, side, type, 'given' AS role FROM sets UNION SELECT property, side, type, 'merged' FROM tg WHERE type <> target AND target IN (SELECT node FROM nodes) UNION SELECT property, side, type, 'dropped' FROM tg WHERE target NOT IN (SELECT node FROM nodes)
  UNION SELECT a.property, a.side, a.type, 'redundant' FROM fin a JOIN fin b ON a.property = b.property AND a.side = b.side JOIN strict s ON s.node = a.type AND s.anc = b.type)"""


@query("kg_type_roles", sql("kg_mapping", more=ROLES, body="SELECT property, side, type, role FROM roles"))
def q_roles(spark: SparkSession, d: str) -> DataFrame:
    """What became of the types before clustering; the final ones are tested against brute force."""
    e = kg(spark, d, "kg_edges")
    got = viewer.process_side(_sets(spark, d, True), kg(spark, d, "kg_mapping"), e, kg(spark, d, "kg_counts"), closure(e), ROOT)
    return got.filter("not startswith(role, 'final')").distinct()


@query("kg_thresholds", """WITH h AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(cast(l_quantity AS double)))) AS hs FROM lineitem GROUP BY 1),
g AS (SELECT id, hs, len(hs) AS n, list_transform(range(1, len(hs)), lambda i: hs[i + 1] - hs[i]) AS gaps FROM h),
w AS (SELECT *, CASE WHEN n > 1 THEN list_position(gaps, list_max(gaps)) END AS i FROM g)
SELECT id, CASE WHEN n = 1 THEN hs[1] WHEN i = n - 1 THEN hs[i] ELSE hs[i + 1] END AS threshold, list_median(hs) AS middle FROM w""")
def q_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The height after the widest gap of an order's quantities, taken as merge heights, and their median."""

    heights = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_quantity").cast("double"))).alias("hs"))
    return heights.select("id", con.gap_threshold("hs").alias("threshold"), con.list_median("hs").alias("middle"))


# ---- streaming ---------------------------------------------------------------------------------------------------


@query("kg_stream_typecheck", sql("kg_facts", "kg_types", "kg_constraints", more=_checked("kg_types"), body="SELECT s, p, o, verdict FROM w"))
def q_stream(spark: SparkSession, d: str) -> DataFrame:
    """The type check on a stream of all facts, kept and rejected ones read back from their two sinks."""
    root = scratch_folder(spark, "stream")
    facts = kg(spark, d, "kg_facts")
    files = max(4, len(facts.inputFiles()))  # as many as the facts have, so that no task's share grows with them; in two batches
    facts.repartition(files).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{root}/in")
    full = stash(closure(kg(spark, d, "kg_edges")), "closure")
    start_two_way(stream, stash(kg(spark, d, "kg_types"), "types"), full, kg(spark, d, "kg_constraints"), f"{root}/kept", f"{root}/rejected", f"{root}/log").awaitTermination()
    kept = spark.read.parquet(f"{root}/kept").select("s", "p", "o", F.lit("ok").alias("verdict"))
    return kept.unionByName(spark.read.parquet(f"{root}/rejected").select("s", "p", "o", "verdict"))
