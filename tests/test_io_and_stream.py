import pytest
from pyspark.sql import functions as F

from taxoforge.functions.decisions import answer_part, answer_word
from taxoforge.functions.terms import normalize_literal, unescape
from taxoforge.operators import judge, viewer
from taxoforge.operators.closure import closure
from taxoforge.plans.projection import ROOT, kg
from taxoforge.sources import readers, sinks
from taxoforge.sources.readers import parse_ntriples
from taxoforge.sources.turtle_text import TurtleText
from taxoforge.streaming.typecheck import start_two_way

SF = "/root/testdata/sf0.001"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_ntriples(spark, tmp_path):
    path = write(tmp_path / "a.nt", '# note\n<http://www.wikidata.org/entity/Q1> <http://schema.org/name> "say \\"hi\\" \\u00e9\\U0001F600"@en .\n<http://www.wikidata.org/entity/Q1> <http://www.wikidata.org/prop/direct/P31> <http://www.wikidata.org/entity/Q5> .\n_:b <urn:x> "1"^^<http://www.w3.org/2001/XMLSchema#int> .\nbroken line\n')
    got = {(r["s"], r["p"], r["o"]) for r in readers.read_ntriples(spark, path).collect()}
    assert got == {("wd:Q1", "schema:name", "\"say 'hi' é😀\"@en"), ("wd:Q1", "wdt:P31", "wd:Q5"), ("_:b", "<urn:x>", '"1"^^xsd:int')}
    assert readers.read_ntriples(spark, path, ["http://www.wikidata.org/prop/direct/P31"]).count() == 1
    assert readers.parse_ntriples(spark.read.text(path)).filter("s is null").count() == 1


def test_turtle(spark, tmp_path):
    path = write(tmp_path / "a.ttl", '@prefix a: <urn:a> .\nwd:Q1 rdfs:label "x y"@en ;\n  wdt:P31 wd:Q5 , wd:Q6 .\nwd:Q2 wdt:P31 <http://www.wikidata.org/entity/Q7> .\n')
    got = {(r["s"], r["p"], r["o"]) for r in readers.read_turtle_statements(spark, path).collect()}
    assert got == {("wd:Q1", "rdfs:label", '"x y"@en'), ("wd:Q1", "wdt:P31", "wd:Q5"), ("wd:Q1", "wdt:P31", "wd:Q6"), ("wd:Q2", "wdt:P31", "wd:Q7")}


def test_text_forms(spark, tmp_path):
    t = spark.createDataFrame([("wd:Q1", "wdt:P1", '"a\nb\tc"'), ("wd:Q2", "wdt:P1", "wd:Q1")], "s string, p string, o string")
    out = f"file://{tmp_path}/facts"
    sinks.write_facts(t, out)
    assert {(r["s"], r["o"]) for r in readers.read_tsv_triples(spark, out).collect()} == {("wd:Q1", '"a\\nb\\tc"'), ("wd:Q2", "wd:Q1")}
    sinks.write_rejections(t.withColumn("reason", F.lit("instance_no_label")).withColumn("p", F.lit("wdt:P31")), f"file://{tmp_path}/log")
    assert [r["s"] for r in readers.unlabelled_instances(readers.read_rejections(spark, f"file://{tmp_path}/log")).collect()] == ["wd:Q1", "wd:Q2"]
    m = write(tmp_path / "map.csv", "a,b\nc,d\na,e\nodd\n")
    assert {(r["src"], r["dst"]) for r in readers.read_mapping(spark, m).collect()} == {("a", "e"), ("c", "d")}
    labels = write(tmp_path / "l.tsv", 'Q1\t"one"\nQ2\ttwo\nQ3\ta\tb\n')
    assert {(r["node"], r["label"]) for r in readers.read_labels(spark, labels).collect()} == {("Q1", "one"), ("Q2", "two")}
    ids = write(tmp_path / "ids.csv", "item,name\nhttp://www.wikidata.org/entity/P5,x\n")
    assert [r["id"] for r in readers.read_ids(spark, ids).collect()] == ["P5"]
    counts = write(tmp_path / "c.csv", "cls,n\nhttp://www.wikidata.org/entity/Q5,12\n")
    assert [(r["cls"], r["cnt"]) for r in readers.read_counts(spark, counts).collect()] == [("Q5", 12)]
    edges = spark.createDataFrame([("Q1", "Q2")], "child string, parent string")
    sinks.write_edges(edges, f"file://{tmp_path}/edges")
    assert readers.read_edges(spark, f"file://{tmp_path}/edges").collect() == edges.collect()
    sinks.write_ntriples(edges, f"file://{tmp_path}/nt")
    assert readers.read_ntriples(spark, f"file://{tmp_path}/nt").first()["p"] == "wdt:P279"
    sinks.replace_table(edges, f"file://{tmp_path}/t")
    sinks.replace_table(spark.read.parquet(f"file://{tmp_path}/t").limit(1), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 1


def test_constraint_and_prediction_files(spark, tmp_path):
    c = write(tmp_path / "c.csv", "property,propertyLabel,class,classLabel\nhttp://www.wikidata.org/entity/P1,first,http://www.wikidata.org/entity/Q1,one\nhttp://www.wikidata.org/entity/P1,first,http://www.wikidata.org/entity/Q1,again\n")
    got = readers.read_constraints(spark, c, "subject").collect()
    assert [(r["property"], r["type"], r["type_label"]) for r in got] == [("P1", "Q1", "one")]
    up = write(tmp_path / "u.json", '{"constraints": [{"relation": "wdt:P5", "subject_types": ["wd:Q1 one thing"], "object_types": ["xsd:date"]}]}')
    assert {(r["property"], r["side"], r["type"], r["label"]) for r in readers.read_uploaded_constraints(spark, up).collect()} == {("P5", "subject", "Q1", "one thing"), ("P5", "object", "xsd:date", None)}
    p = write(tmp_path / "p.json", '[{"id": "Q2_Q1", "plabel": "b", "clabel": "a", "answer": " True ", "confidence": 0.5}, {"id": "Q2_Q1", "answer": "False"}]')
    r = readers.read_predictions(spark, p, "m").collect()
    assert [(x["parent"], x["child"], x["answer"]) for x in r] == [("Q2", "Q1", "True")]
    w = write(tmp_path / "r.json", '[{"id": "Q1_Q2", "answer": "True ", "confidence": 0.7}]')
    assert [(x["child"], x["parent"], x["answer"]) for x in readers.read_rewire_results(spark, w).collect()] == [("Q1", "Q2", "True")]
    tags = write(tmp_path / "t.txt", "[CLS] Q1\nQ2\n\n")
    assert [x["id"] for x in readers.read_tagged_ids(spark, tags).collect()] == ["Q1"]
    assert readers.read_tagged_ids(spark, tags, "").count() == 2
    dump = write(tmp_path / "d.sql", "INSERT INTO x VALUES (1,'Q5','D',7),(2,'Q5','D',8),(3,'Q6','L',9),(4,'P7','D',1);\n")
    assert {(x["page_id"], x["node"]) for x in readers.read_usage_dump(spark, dump).collect()} == {("7", "Q5")}


def test_unescape_and_answers(spark):
    one = spark.range(1)
    assert one.select(unescape(F.lit(r"a\tbé\\c"))).first()[0] == "a\tbé\\c"
    assert one.select(normalize_literal(F.lit('"x"@zh-classical'))).first()[0] == '"x"@lzh'
    said = {"**Answer: True** then Answer: no": "False", "x **False** y": "False", "nothing": "None", "Answer: maybe": "None", "ANSWER true": "None", "Answer: yes, TRUE": "True"}
    for text, want in said.items():
        assert one.select(answer_word(answer_part(F.lit(text)))).first()[0] == want


def test_judge_and_messages(spark):
    e = spark.createDataFrame([("a", "b", "cat {x}", "a pet", "animal", "alive")], "child string, parent string, clabel string, cdesc string, plabel string, pdesc string")
    seen = []
    r = judge.judge_edges(e, judge=lambda g: lambda ts: [("**Answer: " + str("cat {x} (a pet)" in t[-1]["content"] and g.max_tokens == 50) + "**", 0.25) for t in ts]).first()
    assert (r["answer"], r["answer_inverse"], r["confidence"]) == ("True", "True", 0.25) and seen == []
    m = e.select(judge.messages(F.col("clabel"), "parts").alias("m")).first()["m"]
    assert [x["role"] for x in m] == ["system", "user"]


def test_viewer_requests(spark):
    e, labels = kg(spark, SF, "kg_edges"), kg(spark, SF, "kg_labels")
    assert '"directSuperclasses":["C:place"]' in viewer.taxonomy_json(e, labels, "R:1", ROOT)
    with pytest.raises(viewer.NotFound):
        viewer.taxonomy_json(e, labels, "none", ROOT)
    with pytest.raises(viewer.BadRequest):
        viewer.ask_labels(labels, ["rubbish!"])
    with pytest.raises(viewer.NotFound):
        viewer.summary(kg(spark, SF, "kg_constraints"), kg(spark, SF, "kg_mapping"), e, kg(spark, SF, "kg_counts"), e, labels, ROOT, "other")


def test_stream_splits_facts(spark, tmp_path):
    f = kg(spark, SF, "kg_facts")
    f.limit(300).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("s string, p string, o string").parquet(f"file://{tmp_path}/in")
    q = start_two_way(stream, kg(spark, SF, "kg_types"), closure(kg(spark, SF, "kg_edges")), kg(spark, SF, "kg_constraints"), f"file://{tmp_path}/kept", f"file://{tmp_path}/rejected", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    n = spark.read.parquet(f"file://{tmp_path}/kept").count() + spark.read.parquet(f"file://{tmp_path}/rejected").count()
    assert n == 300


def test_each_escape_is_decoded(spark):
    rows = {r"\U0001F600 and \U0001F601": "😀 and 😁", r"a\\U0001F600": r"a\U0001F600", r"\ud83d\ude00\ud83d x": "😀\ufffd x", r"q\"z\" \' \u0022": "q'z' ' '", r"b\\s\t\n": "b\\s\t\n", r"\UFFFFFFFF \q": "\ufffd \\q", "": "", "e\rx": "ex"}
    df = spark.createDataFrame([(k, v) for k, v in rows.items()], "t string, want string")
    assert [r for r in df.select("t", "want", unescape(F.col("t")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_odd_lines_of_ntriples(spark):
    big = "x\\n\\\"" * 40_000
    lines = {
        '<urn:a> <urn:b> "say" . # "quoted" comment': ("<urn:a>", "<urn:b>", '"say"'),
        '<urn:a> <urn:b> "say\\\\" . # "quoted" .': ("<urn:a>", "<urn:b>", '"say\\"'),
        '_:x <urn:b> """l"o"""@en .': ("_:x", "<urn:b>", '"l"o"@en'),
        '<urn:a><urn:b><urn:c>.': ("<urn:a>", "<urn:b>", "<urn:c>"),
        f'<urn:a> <urn:b> "{big}" .': ("<urn:a>", "<urn:b>", '"' + "x\n'" * 40_000 + '"'),
        '<urn:a> <urn:b> "open .': (None, None, None),
        '<urn:a> <urn:b> "a"b" .': (None, None, None),
        '<urn:a> "lit" <urn:c> .': (None, None, None),
    }
    got = parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["s"], r["p"], r["o"]) for r in got] == list(lines.values())


def test_whole_turtle(spark, tmp_path):
    text = """@prefix wd: <http://www.wikidata.org/entity/> .
PREFIX ex: <urn:ex:>
# a comment . ; ,
wd:Q1 a ex:Thing ; ex:p "x . y;" , "lang"@en-GB, \"\"\"long "q"
line .\"\"\"; ex:n 5, -2.5, true .
ex:a.b ex:q [ ex:r 'it' ; ex:s [] ] ; ex:l (1 wd:Q3).
[ ex:z ex:y ] .
"""
    (tmp_path / "a.ttl").write_text(text)
    got = [tuple(r) for r in readers.read_turtle(spark, f"file://{tmp_path}/a.ttl").collect()]
    blank = {}
    short = [tuple(blank.setdefault(x, f"_:{len(blank)}") if x.startswith("_:") else x for x in t) for t in got]
    ex = lambda x: f"<urn:ex:{x}>"
    want = [("wd:Q1", "rdf:type", ex("Thing")), ("wd:Q1", ex("p"), '"x . y;"'), ("wd:Q1", ex("p"), '"lang"@en-GB'), ("wd:Q1", ex("p"), "\"long 'q'\nline .\"")]
    want += [("wd:Q1", ex("n"), f'"{v}"^^xsd:{t}') for v, t in (("5", "integer"), ("-2.5", "decimal"), ("true", "boolean"))]
    assert short[:7] == want and len(short) == 16
    assert {(p, o) for _, p, o in short[7:] if not o.startswith("_:")} == {(ex("r"), '"it"'), ("rdf:first", "wd:Q3"), ("rdf:first", '"1"^^xsd:integer'), ("rdf:rest", "rdf:nil"), (ex("z"), ex("y"))}
    for bad in ("<a> <b> .", "<a> <b> <c>", '<a> <b> "open', "<a> <b> [ <c> <d> ."):
        with pytest.raises(ValueError):
            list(TurtleText(bad).triples())


def test_order_of_lines_over_files_and_splits(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"part-{i}").write_text("".join(f"k{(i * 400 + j) % 50},v{i * 400 + j}\n" for j in range(400 if i % 2 else 40)))
    last = {}
    for i in range(6):
        for j in range(400 if i % 2 else 40):
            last[f"k{(i * 400 + j) % 50}"] = f"v{i * 400 + j}"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = {r["src"]: r["dst"] for r in readers.read_mapping(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == last


def test_viewer_pages(spark):
    e, labels, mapping = kg(spark, SF, "kg_edges"), kg(spark, SF, "kg_labels"), kg(spark, SF, "kg_mapping")
    v = viewer.TaxonomyViewer({"core": (e, labels)}, ROOT, {"core": mapping})
    page, warning = v.ask("core", "B:Brand#2")
    assert warning == "B:Brand#2 was merged into B:Brand#3" and '"uri":"B:Brand#3"' in page and v.ask("core", "B:Brand#2")[0] is page
    assert v.ask("core", "R:1")[1] is None
    for bad, error in ((("core", ""), viewer.BadRequest), (("core", "none"), viewer.NotFound), (("x", "R:1"), viewer.NotFound)):
        with pytest.raises(error):
            v.ask(*bad)
    rows = viewer.subgraph_rows(e, labels, "N:3", ROOT)
    tree, drawing = viewer.html_tree(rows, ROOT), viewer.svg_graph(rows, ROOT)
    assert tree.count("<ul>") == tree.count("</ul>") == 4 and drawing.count("<line") == rows.count() == 3 and drawing.count("<rect") == 4
    with pytest.raises(ValueError):
        viewer.html_tree(rows, ROOT, most=2)
    roles = spark.createDataFrame([("subject", "A", "class a", "given"), ("subject", "B", "class b", "final_ancestor"), ("object", "C", "class c", "dropped")], "side string, type string, type_label string, role string")
    metrics = spark.createDataFrame([("subject", "B", 1.5, 2.0, 0.25, 0.0)], "side string, anc string, avg_distance double, expansion_ratio double, depth_ratio double, ic_difference double")
    text = viewer.text_summary(roles, "P1", "part", metrics)
    assert [x for x in text.splitlines() if x.startswith("(")] == [f"({i}) {t}" for i, (_, t) in enumerate(viewer.SECTIONS, 1)]
    assert "B (class b)  avg_distance=1.5000" in text and text.count("B (class b)") == 2


def test_the_word_of_an_answer_is_found_once(spark):
    """The pattern that finds it is not inside the function that looks at each token."""
    from taxoforge.functions.decisions import answer_part, answer_word, token_confidence

    df = spark.createDataFrame([("so it is. Answer: Yes", 0.25), ("quiet", 0.0)], "answer string, want double").withColumn("ts", F.split("answer", " "))
    odds = F.transform("ts", lambda x, i: 1 / (i + 1))
    got = df.select("want", token_confidence(F.col("ts"), F.col("ts"), odds, answer_word(answer_part(F.col("answer")))).alias("c"))
    assert [r["c"] for r in got.collect()] == [0.2, 0.0]
    plan = got._jdf.queryExecution().analyzed().toString()
    plan = plan.lower()
    inner = plan[plan.index("filter(") :].split("rlike")[0]
    assert inner and "regexp_extract" not in inner
