"""One pass that judges facts gives what the two passes of their own give."""

import random

from taxoforge.operators import facts
from taxoforge.operators.closure import closure
from taxoforge.plans import stages


def _case(spark, seed):
    r = random.Random(seed)
    names = [f"i{k}" for k in range(30)] + ["hot"]
    rows = [(r.choice(names), r.choice(["p", "q", "free", "wdt:P31", "wdtn:x", "rdf:type", "skos:prefLabel", "ext"]), r.choice([*names, '"t"@en', '"t"@de', '"5"^^xsd:decimal'])) for _ in range(300)]
    rows += [("hot", "p", r.choice(names)) for _ in range(200)] + [(None, "p", "i1"), ("i1", "p", None)]
    one = lambda n, k: spark.createDataFrame([(x,) for x in r.sample(names, k)], f"{n} string")
    e = spark.createDataFrame([("a", "r"), ("b", "r"), ("aa", "a"), ("bb", "b")], "child string, parent string")
    types = spark.createDataFrame([(x, r.choice(["a", "b", "aa", "bb"])) for x in r.sample(names, 22) for _ in range(2)], "inst string, cls string").distinct()
    rules = spark.createDataFrame([("p", "subject", "a"), ("p", "object", "b"), ("q", "object", "bb"), ("q", "object", "a")], "property string, side string, type string")
    sets = (one("s", 25), one("s", 4), one("cls", 2), spark.createDataFrame([("ext",)], "property string"))
    return spark.createDataFrame(rows, "s string, p string, o string"), sets, types, closure(e), rules


def test_one_pass_equals_two(spark):
    for seed in (1, 2):
        t, sets, types, full, rules = _case(spark, seed)
        apart = facts.fact_verdicts(t, *sets)
        kept = apart.filter("verdict = 'kept'").select("s", "p", "o")
        checked = facts.check_facts(kept, types, full, rules)
        got = facts.judged_facts(t, *sets, types, rules, facts.satisfied(types, full, rules)).collect()
        order = lambda rows: sorted(map(str, map(tuple, rows)))
        assert order(x[:4] for x in got) == order(apart.collect())
        assert order((*x[:3], x[4]) for x in got if x["verdict"] == "kept") == order(checked.collect())
        assert len({x["verdict"] for x in got}) > 5 and len({x["checked"] for x in got}) > 4


def test_the_stage_writes_the_facts_once(spark, monkeypatch):
    t, sets, _, _, rules = _case(spark, 3)
    made = []
    for m in (facts, stages):
        write = m.stash
        monkeypatch.setattr(m, "stash", lambda df, tag, write=write: made.append((tag, len(df.columns))) or write(df, tag))
    e = spark.createDataFrame([("a", "r"), ("b", "r"), ("aa", "a"), ("bb", "b")], "child string, parent string")
    none = spark.createDataFrame([], "stage string, step int, op string, child string, parent string")
    taxonomy = stages.Taxonomy(e, e, spark.createDataFrame([], "src string, dst string"), none)
    out = stages.build_facts(t, taxonomy, rules, spark.createDataFrame([("aa",)], "cls string"), sets[2], sets[3], "r")
    assert [x for x in made if x[0] in ("facts", "checked")] == [("facts", 5)]
    assert out["fact_log"].count() + out["check_log"].count() + out["facts"].count() == t.count()
