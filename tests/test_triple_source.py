"""The triple source against the line reader, and visitors as a table function."""

import gzip
import random

import pytest

from taxoforge.operators import visits
from taxoforge.sources import readers, triple_source

WDT, LABEL = "http://www.wikidata.org/prop/direct/", "http://www.w3.org/2000/01/rdf-schema#label"


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    """Lines of many lengths over three files, one compressed, one without a last line end, with Windows line ends in one."""
    root, rnd = tmp_path_factory.mktemp("dump"), random.Random(6)
    lines = []
    for i in range(400):
        s = f"<http://www.wikidata.org/entity/Q{i}>"
        lines.append(rnd.choice([f"{s} <{WDT}P{i % 4}> <http://www.wikidata.org/entity/Q{i * 7}> .", f'{s} <{LABEL}> "{"x" * rnd.randrange(90)}é {i}"@en . # <a> "b"', f'_:b{i} <http://schema.org/name> "n{i}" .', "", "  # comment", f"broken {i} <line", f'\t{s}\t<{WDT}P1>\t"{i}"^^<http://www.w3.org/2001/XMLSchema#decimal> .']))
    (root / "a.nt").write_bytes("\n".join(lines[:170]).encode())
    (root / "b.nt.gz").write_bytes(gzip.compress(("\n".join(lines[170:250]) + "\n").encode()))
    (root / "c.nt").write_bytes(("\r\n".join(lines[250:]) + "\n\n").encode())
    (root / "d.nt").write_bytes(b"")
    (root / "_hidden").write_bytes(lines[0].encode())
    return str(root), [x for x in lines if x.strip() and not x.strip().startswith("#")]


@pytest.mark.parametrize("size", [1, 37, 500, 1 << 20])
def test_every_line_is_read_once(dump, size, monkeypatch):
    root, lines = dump
    for block in (1, 64, 1 << 20) if size > 1 else (50,):
        monkeypatch.setattr(triple_source, "BATCH_BYTES", block)
        reader = triple_source.TripleReader({"path": root, "splitBytes": str(size)})
        got = [v for split in reader.partitions() for batch in reader.read(split) for v in batch.column(1).to_pylist()]
        assert sorted(got) == sorted(lines)


def test_tasks_stay_few_however_small_the_splits(tmp_path):
    line = f"<http://www.wikidata.org/entity/Q{{}}> <{WDT}P1> <http://www.wikidata.org/entity/Q1> ."
    (tmp_path / "a.nt").write_text("\n".join(line.format(i) for i in range(30_000)))
    reader = triple_source.TripleReader({"path": str(tmp_path), "splitBytes": "1000"})
    parts = reader.partitions()
    assert triple_source.PARTS <= len(parts) <= 2 * triple_source.PARTS and all(s.start % 1000 == 0 for s in parts)
    got = [v for split in parts for batch in reader.read(split) for v in batch.column(1).to_pylist()]
    assert got == [line.format(i) for i in range(30_000)]


def test_equal_to_the_line_reader_and_pushed_down(spark, dump, capsys):
    root, lines = dump
    triple_source.register(spark)
    df = spark.read.format("ntriples").option("splitBytes", 777).load(f"file://{root}")
    want = sorted(map(tuple, readers.read_ntriples(spark, f"file://{root}/*.nt*").collect()))
    assert sorted(map(tuple, triple_source.triples(df).collect())) == want and len(want) > 200
    assert df.filter("p is null").count() == sum(x.startswith("broken") for x in lines)
    some = df.filter("p in ('wdt:P1', 'rdfs:label')")
    assert sorted(map(tuple, triple_source.triples(some).collect())) == [t for t in want if t[1] in ("wdt:P1", "rdfs:label")]
    one = df.filter("p = 'wdt:P2'")
    assert one.count() == sum(t[1] == "wdt:P2" for t in want) and df.filter("p = 'wdt:P2' and p = 'wdt:P3'").count() == 0
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo" in plan.split("PushedFilters")[1][:120] if "PushedFilters" in plan else "Filter" not in plan
    with pytest.raises(Exception, match="path"):
        spark.read.format("ntriples").load().count()


def test_pushed_filters_are_kept_back(dump):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = triple_source.TripleReader({"path": dump[0]})
    left = list(reader.pushFilters([In(("p",), ("wdt:P1", "wdt:P2")), EqualTo(("p",), "wdt:P2"), EqualTo(("value",), "x"), GreaterThan(("p",), "a")]))
    assert reader.wanted == {"wdt:P2"} and len(left) == 2
    got = {p for split in reader.partitions() for batch in reader.read(split) for p in batch.column(0).to_pylist()}
    assert got == {"wdt:P2"}


def test_stream_takes_new_files_once(spark, tmp_path):
    triple_source.register(spark)
    (tmp_path / "in").mkdir()
    line = f"<http://www.wikidata.org/entity/Q{{}}> <{WDT}P1> <http://www.wikidata.org/entity/Q1> .\n"
    (tmp_path / "in/1.nt").write_text("".join(line.format(i) for i in range(5)))
    lines = spark.readStream.format("ntriples").load(f"file://{tmp_path}/in")
    q = lines.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/log").start(f"file://{tmp_path}/out")
    try:
        q.processAllAvailable()
        (tmp_path / "in/2.nt").write_text("".join(line.format(i) for i in range(5, 9)))
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.schema(triple_source.SCHEMA).parquet(f"file://{tmp_path}/out")
    assert sorted(r["s"] for r in triple_source.triples(got).collect()) == [f"wd:Q{i}" for i in range(9)]


class Longest:
    def visit(self, subject, facts):
        return [(subject, max((o for os in facts.values() for o in os), key=len), sorted(facts))]

    def result(self):
        return [("end", None, None)]


def test_visitors_from_sql(spark):
    spark.udtf.register("visited", visits.entity_function({"longest": (Longest, "s string, o string, ps array<string>")}))
    rows = [("a", "p", "x"), ("a", "q", "long"), ("a", "p", "x"), ("b", "p", "y"), (None, "p", "z")]
    spark.createDataFrame([(*r, 1) for r in rows], "s string, p string, o string, more int").createOrReplaceTempView("visited_rows")
    got = [tuple(r) for r in spark.sql("SELECT * FROM visited(TABLE(visited_rows), 'longest') WHERE s <> 'end' OR s IS NULL").collect()]
    assert sorted(got, key=str) == [("a", "long", ["p", "q"]), ("b", "y", ["p"]), (None, "z", ["p"])]
    assert spark.sql("SELECT * FROM visited(TABLE(SELECT * FROM visited_rows WHERE s = 'none'), 'longest')").count() == 0
    for bad in ("visited(TABLE(visited_rows), 'other')", "visited(TABLE(SELECT s FROM visited_rows), 'longest')"):
        with pytest.raises(Exception, match="no visitor|must be a table"):
            spark.sql(f"SELECT * FROM {bad}").collect()
