"""One value in half of all rows: found, spread, and checked like any other."""

from pyspark.sql import functions as F

from taxoforge.operators import facts
from taxoforge.operators.closure import closure


def triples(spark):
    rows = [(f"s{i}", f"p{i % 3}", "hot" if i % 2 else f"o{i % 700}") for i in range(4000)] + [("s1", "p1", "hot"), ("x", None, None), (None, "p0", "o1")]
    return spark.createDataFrame(rows, "s string, p string, o string").repartition(5).cache(), rows


def test_hot_keys_are_found(spark):
    df, _ = triples(spark)
    hot = facts.hot_keys(df, ["s", "p", "o"])
    assert "hot" in hot["o"] and set(hot["p"]) == {"p0", "p1", "p2"} and len(hot["o"]) < 2000
    assert facts.hot_keys(df.limit(0), ["s"]) == {"s": []}


def test_hot_rows_are_spread(spark):
    df, rows = triples(spark)
    members = spark.createDataFrame([("hot", 1), ("o1", 2), ("none", 3)], "member string, what int")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = facts.looked_up(df, "o", members, ["hot"])
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("i")).count().collect()]
        assert max(sizes) < 0.4 * sum(sizes) and sum(sizes) == len(rows)
        want = {"hot": 1, "o1": 2}
        assert sorted(map(str, got.select("s", "p", "o", "what").collect())) == sorted(map(str, facts.looked_up(df, "o", members, []).select("s", "p", "o", "what").collect()))
        assert all(r["what"] == want.get(r["o"]) for r in got.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_verdicts_with_one_object_in_half_of_all_facts(spark):
    df, rows = triples(spark)
    types = spark.createDataFrame([(f"s{i}", "A" if i % 5 else "B") for i in range(3000)] + [("hot", "B"), ("o1", "A"), ("o2", "C")], "inst string, cls string")
    edges = spark.createDataFrame([("A", "R"), ("B", "R"), ("C", "B")], "child string, parent string")
    rules = [("p0", "subject", "A"), ("p0", "object", "B"), ("p1", "subject", "R"), ("p1", "object", "A"), ("p2", "object", "R")]
    got = facts.check_facts(df, types, closure(edges), spark.createDataFrame(rules, "property string, side string, type string"))
    above = {"A": {"A", "R"}, "B": {"B", "R"}, "C": {"C", "B", "R"}, "R": {"R"}}
    held = {r["inst"]: r["cls"] for r in types.collect()}

    def verdict(s, p, o):
        for side, word, x in (("subject", "domain", s), ("object", "range", o)):
            allowed = {t for q, e, t in rules if q == p and e == side}
            if allowed and x not in held:
                return f"no_types_for_{side}"
            if allowed and not allowed & above[held[x]]:
                return f"{word}_constraint_not_satisfied"
        return "ok"

    out = [tuple(r) for r in got.collect()]
    assert sorted(map(str, out)) == sorted(str((*r, verdict(*r))) for r in rows) and len({v for *_, v in out}) == 5


def test_flags_in_one_join(spark):
    df, rows = triples(spark)
    sets = {"a": spark.createDataFrame([("hot",), ("o1",), ("hot",)], "x string"), "b": spark.createDataFrame([("o1",), ("o2",)], "y string")}
    for hot in ([], ["hot", "absent"]):
        got = facts.flagged(df, "o", sets, hot).collect()
        assert len(got) == len(rows) and all((r["a"], r["b"]) == (r["o"] in ("hot", "o1"), r["o"] in ("o1", "o2")) for r in got)
