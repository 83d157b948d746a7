"""A knowledge graph made of the star-schema tables, in SQL that Spark and other engines share.

Regions, nations, market segments, part types, brands and sizes become classes, parts and customers instances, purchases
facts. Each relation is one query over tables or over relations before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxoforge.scratch import stash

ROOT = "C:entity"


def _spark_hex4(x: str) -> str:
    return f"cast(conv(substr(md5({x}), 1, 4), 16, 10) as int)"


def _duck_hex4(x: str) -> str:
    return f"cast(concat('0x', substr(md5({x}), 1, 4)) as int)"


def relations(hex4: Callable[[str], str]) -> dict[str, tuple[list[str], str]]:
    """Name: what it reads, and its query. hex4 gives the SQL for the first four hex digits of a text's MD5 as a number."""
    edge = "concat(p.parent, '|', p.child, '|', p.model)"
    return {
        "kg_edges": (["region", "nation", "customer", "part"], """
            SELECT DISTINCT child, parent FROM (SELECT 'C:agent' AS child, 'C:entity' AS parent UNION ALL SELECT 'C:place', 'C:entity' UNION ALL SELECT 'C:product', 'C:entity'
            UNION ALL SELECT 'C:customer', 'C:agent' UNION ALL SELECT 'C:supplier', 'C:agent'
            UNION ALL SELECT concat('R:', cast(r_regionkey AS string)), 'C:place' FROM region
            UNION ALL SELECT concat('N:', cast(n_nationkey AS string)), concat('R:', cast(n_regionkey AS string)) FROM nation
            UNION ALL SELECT concat('SEG:', c_mktsegment), 'C:customer' FROM customer
            UNION ALL SELECT concat('T:', p_type), 'C:product' FROM part
            UNION ALL SELECT concat('B:', p_brand), 'C:product' FROM part
            UNION ALL SELECT concat('TB:', p_type, ':', p_brand), concat('T:', p_type) FROM part
            UNION ALL SELECT concat('TB:', p_type, ':', p_brand), concat('B:', p_brand) FROM part
            UNION ALL SELECT concat('TBS:', p_type, ':', p_brand, ':', cast(p_size AS string)), concat('TB:', p_type, ':', p_brand) FROM part) e"""),
        "kg_types": (["part", "customer"], """
            SELECT concat('part:', cast(p_partkey AS string)) AS inst, concat('TBS:', p_type, ':', p_brand, ':', cast(p_size AS string)) AS cls FROM part
            UNION ALL SELECT concat('cust:', cast(c_custkey AS string)), concat('SEG:', c_mktsegment) FROM customer
            UNION ALL SELECT concat('cust:', cast(c_custkey AS string)), concat('N:', cast(c_nationkey AS string)) FROM customer"""),
        "kg_facts": (["orders", "lineitem"], """
            SELECT DISTINCT concat('cust:', cast(o_custkey AS string)) AS s, 'bought' AS p, concat('part:', cast(l_partkey AS string)) AS o
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""),
        "kg_constraints": (["customer", "region", "part"], """
            SELECT DISTINCT 'bought' AS property, 'subject' AS side, concat('SEG:', c_mktsegment) AS type FROM customer WHERE c_mktsegment LIKE 'B%'
            UNION ALL SELECT DISTINCT 'bought', 'subject', concat('R:', cast(r_regionkey AS string)) FROM region WHERE r_regionkey = 1
            UNION ALL SELECT DISTINCT 'bought', 'object', concat('T:', p_type) FROM part WHERE p_type LIKE 'P%'
            UNION ALL SELECT DISTINCT 'bought', 'object', concat('B:', p_brand) FROM part WHERE p_brand LIKE '%#4'"""),
        "kg_noisy": (["kg_edges"], """
            SELECT child, parent FROM kg_edges
            UNION SELECT child, 'C:product' FROM kg_edges WHERE child LIKE 'TB:%'
            UNION SELECT 'C:orphan', 'C:entity'"""),
        "kg_cyclic": (["kg_noisy"], """
            SELECT child, parent FROM kg_noisy UNION SELECT 'N:0', 'N:1' UNION SELECT 'N:1', 'N:2' UNION SELECT 'N:2', 'N:0'"""),
        "kg_looped": (["kg_noisy"], f"""
            SELECT child, parent FROM kg_noisy
            UNION SELECT parent, child FROM kg_noisy WHERE child LIKE 'TB%' AND parent <> 'C:product' AND {hex4("concat(child, '|', parent)")} % 31 = 0"""),
        "kg_deleted": (["kg_noisy"], f"""
            SELECT child, parent FROM kg_noisy WHERE {hex4("concat(child, '|', parent)")} % 23 = 0"""),
        "kg_inserted": (["kg_noisy"], f"""
            SELECT DISTINCT child, 'C:supplier' AS parent FROM kg_noisy WHERE child LIKE 'TB:%' AND {hex4("concat(child, '+')")} % 29 = 0
            UNION SELECT 'C:supplier', 'X:made' UNION SELECT 'X:made', 'C:place' UNION SELECT child, parent FROM kg_noisy WHERE {hex4("concat(child, '|', parent)")} % 230 = 0"""),
        "kg_edited": (["kg_noisy", "kg_deleted", "kg_inserted"], """
            SELECT child, parent FROM (SELECT child, parent FROM kg_noisy EXCEPT SELECT child, parent FROM kg_deleted) k UNION SELECT child, parent FROM kg_inserted"""),
        "kg_asked": (["part"], """
            SELECT DISTINCT concat('TBS:', a.p_type, ':', a.p_brand, ':', cast(a.p_size AS string)) AS child, concat('B:', b.p_brand) AS parent FROM part a JOIN (SELECT DISTINCT p_size, p_brand FROM part) b ON a.p_size = b.p_size
            UNION SELECT concat('B:', a.p_brand), concat('TB:', a.p_type, ':', a.p_brand) FROM part a UNION SELECT concat('TB:', a.p_type, ':', a.p_brand), 'C:entity' FROM part a
            UNION SELECT concat('T:', p_type), 'C:nowhere' FROM part UNION SELECT concat('T:', p_type), concat('T:', p_type) FROM part"""),
        "kg_type_changes": (["kg_types", "part", "customer"], f"""
            SELECT inst, cls, -1 AS change FROM kg_types WHERE {hex4("concat(inst, '|', cls)")} % 19 = 0 OR {hex4("inst")} % 41 = 0
            UNION ALL SELECT concat('cust:', cast(c_custkey AS string)), 'R:1', 1 FROM customer WHERE {hex4("concat('+', c_mktsegment, cast(c_custkey AS string))")} % 37 = 0
            UNION ALL SELECT concat('part:', cast(p_partkey AS string)), concat('T:', p_type), 1 FROM part WHERE {hex4("concat('+', p_brand, cast(p_partkey AS string))")} % 23 = 0"""),
        "kg_types_after": (["kg_types", "kg_type_changes"], """
            SELECT inst, cls FROM (SELECT inst, cls FROM kg_types EXCEPT SELECT inst, cls FROM kg_type_changes WHERE change = -1) k UNION SELECT inst, cls FROM kg_type_changes WHERE change = 1"""),
        "kg_constraint_changes": (["kg_constraints", "part"], f"""
            SELECT property, side, type, -1 AS change FROM kg_constraints WHERE {hex4("concat(type, '-')")} % 3 = 0
            UNION ALL SELECT DISTINCT 'bought', 'object', concat('TB:', p_type, ':', p_brand), 1 FROM part WHERE p_type LIKE 'S%' AND p_brand LIKE '%#1%'
            UNION ALL SELECT DISTINCT 'returned', 'object', concat('T:', p_type), 1 FROM part WHERE p_type LIKE 'E%'"""),
        "kg_constraints_after": (["kg_constraints", "kg_constraint_changes"], """
            SELECT property, side, type FROM (SELECT property, side, type FROM kg_constraints EXCEPT SELECT property, side, type FROM kg_constraint_changes WHERE change = -1) k
            UNION SELECT property, side, type FROM kg_constraint_changes WHERE change = 1"""),
        "kg_fact_changes": (["kg_facts", "orders", "lineitem"], f"""
            SELECT s, p, o, -1 AS change FROM kg_facts WHERE {hex4("concat(s, '|', o)")} % 17 = 0
            UNION ALL SELECT DISTINCT concat('cust:', cast(o_custkey AS string)), 'returned', concat('part:', cast(l_partkey AS string)), 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
            UNION ALL SELECT DISTINCT concat('cust:', cast(o_custkey AS string)), 'bought', concat('part:', cast(o_custkey AS string)), 1 FROM orders"""),
        "kg_facts_after": (["kg_facts", "kg_fact_changes"], """
            SELECT s, p, o FROM (SELECT s, p, o FROM kg_facts EXCEPT SELECT s, p, o FROM kg_fact_changes WHERE change = -1) k UNION SELECT s, p, o FROM kg_fact_changes WHERE change = 1"""),
        "kg_chained": (["kg_noisy", "nation"], """
            SELECT child, parent FROM kg_noisy UNION SELECT 'X:up', 'C:place' UNION SELECT 'X:mid', 'X:up' UNION SELECT 'X:low', 'X:mid'
            UNION SELECT concat('X:leaf', cast(n_nationkey AS string)), 'X:low' FROM nation UNION SELECT 'X:side', 'C:agent' UNION SELECT 'C:customer', 'X:side'"""),
        "kg_places": (["region", "nation"], """
            SELECT 'C:place' AS child, 'C:entity' AS parent UNION ALL SELECT DISTINCT concat('R:', cast(r_regionkey AS string)), 'C:place' FROM region
            UNION ALL SELECT DISTINCT concat('N:', cast(n_nationkey AS string)), concat('R:', cast(n_regionkey AS string)) FROM nation"""),
        "kg_counts": (["kg_types"], "SELECT cls, count(*) AS cnt FROM kg_types GROUP BY cls"),
        "kg_untyped": (["part", "customer"], """
            SELECT concat('part:', cast(p_partkey AS string)) AS inst, concat('TBS:', p_type, ':', p_brand, ':', cast(p_size AS string)) AS cls FROM part WHERE p_partkey % 7 <> 0
            UNION ALL SELECT concat('cust:', cast(c_custkey AS string)), concat('SEG:', c_mktsegment) FROM customer WHERE c_custkey % 10 <> 0
            UNION ALL SELECT concat('cust:', cast(c_custkey AS string)), concat('N:', cast(c_nationkey AS string)) FROM customer WHERE c_custkey % 10 <> 0"""),
        "kg_mapping": (["nation", "region", "part"], """
            SELECT concat('N:', cast(n_nationkey AS string)) AS src, concat('N:', cast(n_nationkey + 1 AS string)) AS dst FROM nation WHERE n_nationkey < 2
            UNION ALL SELECT concat('N:', cast(n_nationkey AS string)), 'X:gone' FROM nation WHERE n_nationkey % 10 = 3
            UNION ALL SELECT DISTINCT concat('B:', p_brand), 'B:Brand#3' FROM part WHERE p_brand LIKE '%#2'
            UNION ALL SELECT DISTINCT concat('TBS:', p_type, ':', p_brand, ':', cast(p_size AS string)), concat('TB:', p_type, ':', p_brand) FROM part WHERE p_size % 25 = 7
            UNION ALL SELECT concat('X:', cast(r_regionkey AS string)), concat('X:', cast((r_regionkey + 1) % 5 AS string)) FROM region"""),
        "kg_labels": (["kg_edges"], """
            SELECT node, concat('class ', lower(node)) AS label FROM (SELECT child AS node FROM kg_edges UNION SELECT parent FROM kg_edges) n"""),
        "kg_predictions": (["kg_noisy"], f"""
            SELECT p.model AS model, p.child AS child, p.parent AS parent,
              CASE WHEN {hex4(f"concat({edge}, 'l')")} % 11 = 0 THEN 'same label' ELSE p.parent END AS plabel,
              CASE WHEN {hex4(f"concat({edge}, 'l')")} % 11 = 0 THEN 'Same Label' ELSE p.child END AS clabel,
              CASE {hex4(f"concat({edge}, 'a')")} % 5 WHEN 0 THEN 'False' WHEN 1 THEN 'None' ELSE 'True' END AS answer,
              CASE {hex4(f"concat({edge}, 'b')")} % 3 WHEN 0 THEN 'True' ELSE 'False' END AS answer_inverse,
              cast({hex4(f"concat({edge}, 'c')")} % 1000 AS double) / 1000 AS confidence,
              cast({hex4(f"concat({edge}, 'd')")} % 1000 AS double) / 1000 AS confidence_inverse
            FROM (SELECT child, parent, model FROM kg_noisy CROSS JOIN (SELECT 'm1' AS model UNION ALL SELECT 'm2' UNION ALL SELECT 'm3') m) p"""),
        "kg_answers": (["conversations"], """
            SELECT concat(cast(conv_id AS string), '-', cast(turn AS string)) AS id,
              CASE (conv_id + turn) % 6 WHEN 0 THEN concat(text, ' Answer: True') WHEN 1 THEN concat('**Answer: no** ', text, ' Answer: FALSE.')
                WHEN 2 THEN concat(text, ' **False**') WHEN 3 THEN concat(text, ' **True**, yes') WHEN 4 THEN concat(text, ' Answer: yes') ELSE text END AS answer
            FROM conversations"""),
        "kg_triples": (["documents", "part", "customer"], """
            SELECT concat('wd:Q', cast(doc_id AS string)) AS s, 'schema:description' AS p, concat('"', cast(n_chars AS string), ' characters"@', lang) AS o FROM documents
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'rdfs:label', concat('"document ', cast(doc_id AS string), '"@', CASE WHEN doc_id % 13 = 0 THEN 'fr' ELSE 'en' END) FROM documents
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'wdt:P31', concat('wd:Q90', cast(doc_id % 9 AS string)) FROM documents WHERE doc_id % 10 <> 3
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'wdt:P407', concat('wd:Q', cast((doc_id * 7) % 200 AS string)) FROM documents
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'wdt:P214', concat('"', cast(doc_id * 31 AS string), '"') FROM documents WHERE doc_id % 4 = 0
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'wdtn:P214', 'wd:Q1' FROM documents WHERE doc_id % 40 = 0
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'rdf:type', 'wikibase:Item' FROM documents WHERE doc_id % 50 = 0
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'skos:prefLabel', '"x"@en' FROM documents WHERE doc_id % 25 = 0
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'wdt:P1476', concat('"', source, '"@', lang) FROM documents
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'wdt:P1082', concat('"', cast(n_chars AS string), '"^^xsd:decimal') FROM documents
            UNION ALL SELECT concat('wd:Q', cast(doc_id AS string)), 'wdt:P577', concat('s:Q', cast(doc_id AS string)) FROM documents WHERE doc_id % 30 = 0"""),
        "kg_ontology": (["nation"], """
            SELECT 'wd:Q900' AS s, 'wdt:P279' AS p, 'wd:Q19478619' AS o UNION ALL SELECT 'wd:Q901', 'wdt:P279', 'wd:Q900' UNION ALL SELECT 'wd:Q902', 'wdt:P279', 'wd:Q13442814'
            UNION ALL SELECT 'wd:Q903', 'wdt:P279', 'wd:Q902' UNION ALL SELECT 'wd:Q904', 'wdt:P31', 'wd:Q124711104' UNION ALL SELECT 'wd:Q904', 'wdt:P279', 'wd:Q905'
            UNION ALL SELECT concat('wd:Q90', cast(n_nationkey % 9 AS string)), 'rdfs:label', concat('"class ', cast(n_nationkey % 9 AS string), '"@en') FROM nation WHERE n_nationkey < 9
            UNION ALL SELECT concat('wd:Q90', cast(n_nationkey % 9 AS string)), 'schema:description', '"a class"@en' FROM nation WHERE n_nationkey < 7
            UNION ALL SELECT concat('wd:P', cast(n_nationkey AS string)), 'rdfs:label', concat('"', lower(n_name), '"@en') FROM nation
            UNION ALL SELECT concat('wd:P', cast(n_nationkey AS string)), 'wikibase:propertyType', CASE WHEN n_nationkey % 3 = 0 THEN 'wikibase:ExternalId' ELSE 'wikibase:String' END FROM nation
            UNION ALL SELECT concat('wd:P', cast(n_nationkey AS string)), 'p:P2302', concat('s:', cast(n_nationkey AS string)) FROM nation
            UNION ALL SELECT concat('s:', cast(n_nationkey AS string)), 'ps:P2302', CASE WHEN n_nationkey % 2 = 0 THEN 'wd:Q21503250' ELSE 'wd:Q21510865' END FROM nation
            UNION ALL SELECT concat('s:', cast(n_nationkey AS string)), 'pq:P2308', concat('wd:Q90', cast(n_regionkey AS string)) FROM nation
            UNION ALL SELECT concat('s:', cast(n_nationkey AS string)), 'pq:P2308', 'wd:Q905' FROM nation"""),
        "kg_vectors": (["embeddings"], "SELECT vec_id AS node, label AS grp, embedding AS vec FROM embeddings"),
    }


#: Relations that plans read again and again are stage tables, written before they are used.
STORED = {"kg_edges", "kg_noisy", "kg_cyclic", "kg_looped", "kg_deleted", "kg_inserted", "kg_chained", "kg_counts", "kg_labels", "kg_predictions", "kg_triples", "kg_ontology", "kg_mapping", "kg_constraints", "kg_facts"}
SPARK = relations(_spark_hex4)
DUCK = relations(_duck_hex4)


def _order(names: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Relations to define, each after what it reads, and the tables below."""
    made, tables = [], []

    def visit(n: str) -> None:
        if n not in SPARK:
            if n not in tables:
                tables.append(n)
        elif n not in made:
            for x in SPARK[n][0]:
                visit(x)
            made.append(n)

    for n in names:
        visit(n)
    return made, tables


def kg(spark: SparkSession, sf_dir: str, name: str, ready: dict[str, DataFrame] | None = None) -> DataFrame:
    """A relation of the projection over the tables of a folder, and over relations that are ready already."""
    made, tables = _order((name,))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables} | (ready or {})
    for n in made:
        if n in frames:
            continue
        reads, text = SPARK[n]
        for r in sorted(reads, key=len, reverse=True):
            frames[r].createOrReplaceTempView(f"taxoforge_{r}")
        for r in sorted(reads, key=len, reverse=True):
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {r} ", f"{word} taxoforge_{r} ").replace(f"{word} {r}\n", f"{word} taxoforge_{r}\n").replace(f"{word} {r})", f"{word} taxoforge_{r})")
            if text.endswith(f"FROM {r}"):
                text = text[: -len(r)] + f"taxoforge_{r}"
        frames[n] = spark.sql(text)
    return stash(frames[name], name) if name in STORED else frames[name]


def with_relations(*names: str) -> str:
    """The relations as common table expressions for other engines, to go on after a comma."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({DUCK[n][1]})" for n in _order(names)[0])
