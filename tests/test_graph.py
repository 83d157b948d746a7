import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoforge.operators import constraints as con
from taxoforge.operators import edits, evaluation, facts, graph, ordering, stats, votes
from taxoforge.operators.closure import ancestors, closure, depths, descendants, nearest_kept, nodes_of, reachable_leaves, root_paths, strict_closure

# parent to child; A to D is a shortcut
M1 = [("A", "E"), ("B", "E"), ("C", "A"), ("C", "B"), ("D", "C"), ("F", "A"), ("G", "D"), ("D", "A")]
COUNTS = [("F", 5), ("G", 3), ("B", 2)]


@pytest.fixture(scope="module")
def m1(spark):
    return spark.createDataFrame(M1, "child string, parent string").cache()


@pytest.fixture(scope="module")
def lean(m1):
    return graph.transitive_reduction(m1).cache()


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(COUNTS, "cls string, cnt long").cache()


def pairs(df, *c):
    return {tuple(r[x] for x in c) for r in df.collect()}


def test_reduction(m1, lean):
    assert pairs(lean, "child", "parent") == set(M1) - {("D", "A")}
    assert pairs(graph.transitive_reduction(lean), "child", "parent") == set(M1) - {("D", "A")}


def test_depth_and_paths(lean):
    assert dict(pairs(depths(lean, "E"), "node", "depth")) == {"E": 0, "A": 1, "B": 1, "C": 2, "F": 2, "D": 3, "G": 4}
    assert dict(pairs(root_paths(lean, "E", 1), "node", "paths")) == {"E": 1, "A": 1, "B": 1, "C": 2, "D": 2, "F": 1, "G": 2}


def test_cumulative_counts(lean, counts):
    got = dict(pairs(graph.cumulative_counts(counts, closure(lean)), "cls", "cum"))
    assert got == {"A": 8, "B": 5, "C": 3, "D": 3, "E": 10, "F": 5, "G": 3}


def test_contraction(lean, counts):
    assert pairs(graph.non_informative(lean, counts), "node") == {("D",)}
    assert pairs(graph.contract(lean, counts), "child", "parent") == {("A", "E"), ("B", "E"), ("C", "A"), ("C", "B"), ("F", "A"), ("G", "C")}


def test_edit_distance(m1, lean, counts):
    assert graph.edge_difference(m1, lean).first()["ged"] == 1
    assert graph.edge_difference(lean, graph.contract(lean, counts)).first()["ged"] == 4


def test_distances_and_wu_palmer(spark, lean):
    full = closure(lean)
    members = spark.createDataFrame([("p", "subject", x) for x in "ABCDEFG"], "property string, side string, type string")
    d = {(r["a"], r["b"]): r["dist"] for r in con.pair_distances(members, full, con.GROUP).collect()}
    assert (d["F", "G"], d["C", "F"], d["A", "B"], d["A", "C"]) == (4, 2, 2, 1)
    w = {(r["a"], r["b"]): r["sim"] for r in evaluation.wu_palmer(nodes_of(lean), strict_closure(lean), depths(lean, "E")).collect()}
    assert w["F", "G"] == 0.5 and abs(w["C", "D"] - 4 / 7) < 1e-12 and w["A", "B"] == 0.5 and w["A", "E"] == 0


def test_common_ancestors(spark, lean, counts):
    full = closure(lean)

    def of(types):
        chunk = spark.createDataFrame([("p", "subject", t, "x") for t in types], "property string, side string, type string, chunk string")
        return con.common_ancestors(chunk, full)

    assert {(r["anc"], tuple(r["covered"]), r["far"]) for r in of("FG").collect()} == {("A", ("F", "G"), 3)}
    assert {(r["anc"], tuple(r["covered"]), r["far"]) for r in of("BCF").collect()} == {("A", ("C", "F"), 1), ("B", ("B", "C"), 1), ("E", ("B", "C", "F"), 2)}
    assert {(r["anc"], r["far"]) for r in of("C").collect()} == {("C", 0)}
    m = {r["anc"]: r for r in con.metrics(of("CF"), full, counts, depths(lean, "E")).collect()}
    assert abs(m["A"]["ic_difference"]) < 1e-12
    chunk = spark.createDataFrame([("p", "subject", "x", "E", ["F", "G"]), ("p", "subject", "y", "E", ["A", "B"])], "property string, side string, chunk string, anc string, covered array<string>")
    m = {r["chunk"]: r["ic_difference"] for r in con.metrics(chunk, full, counts, depths(lean, "E")).collect()}
    assert abs(m["x"] - np.log(0.8)) < 1e-9 and m["y"] == 1.0


def test_redundancy(spark, lean):
    strict = strict_closure(lean)
    t = spark.createDataFrame([("i", "A"), ("i", "C")], "inst string, cls string")
    assert pairs(facts.redundant_types(t, strict), "cls") == {("A",)}
    c = spark.createDataFrame([("p", "subject", "A"), ("p", "subject", "C")], "property string, side string, type string")
    assert pairs(con.redundant_constraints(c, strict), "type") == {("C",)}


def test_groups_and_leaves(spark, lean):
    assert pairs(evaluation.leaf_groups(lean), "grp", "node") == {("A", "F"), ("D", "G")}
    assert ("E", "G") in pairs(reachable_leaves(lean, strict_closure(lean)), "node", "leaf")
    v = spark.createDataFrame([("F", [1.0]), ("G", [1.0])], "node string, vec array<double>")
    assert evaluation.overall_robustness(evaluation.robustness(evaluation.leaf_groups(lean), v)).first()["robustness"] == 0.0


def test_reach_from_a_few(spark, lean):
    one = spark.createDataFrame([("C",)], "node string")
    assert pairs(ancestors(lean, one), "node") == {("C",), ("A",), ("B",), ("E",)}
    assert pairs(descendants(lean, one), "node") == {("C",), ("D",), ("G",)}
    kept = spark.createDataFrame([("E",), ("B",)], "node string")
    assert pairs(nearest_kept(lean, kept).filter("node = 'G'"), "anc", "dist") == {("E", 4), ("B", 3)}


def test_validation(spark, lean):
    assert graph.require_valid(lean) is lean
    loop = lean.unionByName(spark.createDataFrame([("A", "G")], "child string, parent string"))
    v = graph.validate(loop).first()
    assert not v["acyclic"] and v["n_roots"] == 1
    with pytest.raises(ValueError):
        graph.require_valid(loop)


def test_extraction_removes_loops(spark, lean):
    loop = lean.unionByName(spark.createDataFrame([("A", "G"), ("C", "D"), ("X", "F")], "child string, parent string"))
    valid = nodes_of(loop).filter("node <> 'X'")
    got = ordering.rooted_extraction(loop, "E", valid, spark.createDataFrame([("F",)], "node string"))
    assert pairs(got, "child", "parent") == set(M1) - {("D", "A"), ("F", "A")}
    assert graph.validate(got).first()["acyclic"]


def test_mapping(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("q", "q")], "src string, dst string")
    assert dict(pairs(graph.resolve_mapping(m), "src", "dst")) == {"a": "c", "b": "c", "x": "x", "y": "x", "z": "x"}


def test_votes(spark):
    rows = [("m1", "a", "p", "[SUBSUME]", 0.9), ("m2", "a", "p", "[SUBSUME]", 0.7), ("m3", "a", "p", "[IRRELEVANT]", 0.8), ("m1", "b", "p", "[SUBSUME]", 0.1), ("m2", "b", "p", "[REVERSE]", 0.9), ("m3", "b", "p", "[EQUIVALENT]", 0.8)]
    v = spark.createDataFrame(rows, "model string, child string, parent string, verdict string, conf double")
    assert pairs(votes.majority(v), "child", "verdict", "conf") == {("a", "[SUBSUME]", 0.7), ("b", "[SUBSUME]", 1.0)}
    said = "model string, child string, parent string, answer string, answer_inverse string, confidence double, confidence_inverse double"
    rows = [("m1", "a", "p", "True", "False", 0.9, 0.7), ("m2", "a", "p", "true", "false", 0.8, 0.6), ("m3", "a", "p", "False", "False", 0.9, 0.9)]
    rows += [("m1", "b", "p", "True", "False", 0.9, 0.4), ("m2", "b", "p", "None", "False", 0.9, 0.9), ("m3", "b", "p", "True", "False", 0.1, 0.9)]  # no vote at all
    rows += [("m1", "c", "p", "True", "False", 0.9, 0.9), ("m2", "c", "p", "True", "True", 0.9, 0.9), ("m3", "c", "p", "None", "None", 0.9, 0.9)]  # a tie
    p = spark.createDataFrame(rows, said)
    assert pairs(votes.rewire_vote(p), "child", "ok", "conf") == {("a", True, 0.6), ("b", False, 0.0), ("c", False, 0.0)}
    e = spark.createDataFrame([("a", "p"), ("z", "p")], "child string, parent string")
    assert pairs(votes.missing_predictions(e, p), "model", "child") == {("m1", "z"), ("m2", "z"), ("m3", "z")}
    with pytest.raises(ValueError):
        votes.require_predictions(e, p)
    votes.require_predictions(e.filter("child = 'a'"), p)


def test_rewire_golden(spark):
    # p and q under E, q under r too; c under both p and q: r is a hop, E is above p and none
    e = spark.createDataFrame([("p", "E"), ("q", "E"), ("q", "r"), ("r", "E"), ("c", "p"), ("c", "q")], "child string, parent string")
    eq = spark.createDataFrame([("c", "p"), ("p", "E"), ("x", "p")], "child string, parent string")
    c = ordering.rewire_candidates(e, eq, "E").cache()
    assert {tuple(r) for r in c.collect()} == {("p", "c", "q", None), ("p", "c", "q", "r")}
    judged = lambda *rows: spark.createDataFrame(list(rows), "a string, b string, ok boolean, conf double")
    assert pairs(ordering.unpredicted(c, judged()), "child", "parent") == {("p", "q")}
    assert pairs(ordering.unpredicted(c, judged(("p", "q", True, 0.9))), "child", "parent") == {("p", "r")}
    with pytest.raises(ValueError):
        ordering.require_predicted(c, judged(("p", "q", True, 0.9)))
    ordering.require_predicted(c, judged(("p", "q", True, 0.9), ("p", "r", False, 0.9)))
    ok = lambda *rows: pairs(ordering.valid_merges(c, judged(*rows)), "parent", "child")
    assert ok() == ok(("p", "r", False, 0.9)) == ok(("p", "q", True, 0.5)) == ok(("p", "q", True, 0.9), ("p", "r", True, 0.9)) == {("p", "c")}
    assert ok(("p", "q", True, 0.4)) == ok(("p", "q", False, 0.9)) == ok(("p", "q", True, 0.9), ("p", "r", False, 0.9)) == set()
    loop = e.unionByName(spark.createDataFrame([("s", "p"), ("c", "s")], "child string, parent string"))
    with pytest.raises(ValueError):
        ordering.rewire_candidates(loop, eq, "E")


def test_decisions(spark):
    rows = [("p", "c", "False", "False", 0.4, 0.9), ("p", "c", "False", "True", 0.8, 0.6), ("Same", "sAME", "False", None, None, 0.1), ("p", "c", "True", "True", 0.5, 0.5), ("p", "c", None, "True", 0.9, 0.9)]
    df = spark.createDataFrame([("m", str(i), "x", *r) for i, r in enumerate(rows)], "model string, child string, parent string, plabel string, clabel string, answer string, answer_inverse string, confidence double, confidence_inverse double")
    got = [(r["verdict"], r["conf"]) for r in votes.conclude(df).orderBy("child").collect()]
    assert got == [("[SUBSUME]", 0.4), ("[REVERSE]", 0.6), ("[EQUIVALENT]", 1.0), ("[EQUIVALENT]", 0.5), ("[SUBSUME]", 0.9)]


def test_thresholds_and_clusters():
    assert con.max_gap([1, 2, 6]) == 2 and con.max_gap([1, 5, 6]) == 5 and con.max_gap([3]) == 3
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], float)
    assert con.linkage(d)[1] == [1, 2, 9] and con.flat_clusters(d) == [0, 0, 2, 2]


def test_kendall():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 6, 60).astype(float)
    i, j = np.triu_indices(60, 1)
    s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    want = s.sum() / np.sqrt(float((x[i] != x[j]).sum()) * (y[i] != y[j]).sum())
    assert abs(evaluation.kendall_tau_b(x, y) - want) < 1e-12


def test_edits():
    g = edits.Graph(M1)
    assert edits.cut_irrelevant(g, [("D", "A"), ("F", "A"), ("C", "A")], "E") == [(0, "cut", "D", "A"), (1, "delete", "F", "A"), (2, "cut", "C", "A")]
    g = edits.Graph([("A", "E"), ("B", "A"), ("C", "B"), ("D", "C"), ("H", "D")])
    assert edits.cut_irrelevant(g, [("B", "A")], "E") == [] and g.has("B", "A")
    counts = {"D": 1, "C": 2}
    g = edits.Graph(M1)
    assert edits.resolve_reversed(g, [("D", "A"), ("D", "C"), ("A", "E")], "E", counts) == [(0, "cut", "D", "A"), (1, "merge", "D", "C")]
    assert counts == {"C": 3} and g.has("G", "C")
    g = edits.Graph([("A", "E"), ("B", "A"), ("C", "B")])
    assert edits.merge_equivalent(g, [("B", "A"), ("C", "A")], "E", {}, set()) == [(0, "merge", "B", "A")]
    g = edits.Graph([("A", "E"), ("T", "E"), ("B", "A"), ("X", "B"), ("X", "T")])
    assert edits.drop_over_specific(g, "E") == [(1, "delete", "T", "E")]
    g = edits.Graph([("A", "E"), ("T", "E"), ("X", "E"), ("X", "T"), ("B", "A"), ("Y", "X")])  # X hangs on the root and on T, both not below others
    assert edits.drop_over_specific(g, "E") == [(1, "delete", "T", "E")]


def reduced(edges):
    """Transitive reduction, edge by edge."""
    left = set(edges)
    for c, p in sorted(edges):
        seen, todo = set(), [x for x in left if x[0] == c and x != (c, p)]
        while todo:
            x = todo.pop()
            if x[1] not in seen:
                seen.add(x[1])
                todo += [y for y in left if y[0] == x[1]]
        if p in seen:
            left.discard((c, p))
    return left


def test_merges_against_plain_rules():
    """Random graphs: merges one by one with a full reduction after each, as the rules say."""
    rng = np.random.default_rng(8)
    merged = 0
    for _ in range(60):
        n = int(rng.integers(6, 16))
        e = {(f"n{i:02d}", f"n{int(rng.integers(0, i)):02d}") for i in range(1, n) for _ in range(int(rng.integers(1, 4)))}
        e = reduced(e)
        todo = [x for x in sorted(e, key=lambda x: rng.random()) if x[1] != "n00"][:5]
        want, used, error = set(e), set(), False
        for c, p in todo:
            if (c, p) not in want or c in used or p in used:
                continue
            new = {(x, p if y == c else y) for x, y in want if x != c} | {(p, y) for x, y in want if x == c and y != p}
            want = reduced(new)
            used.add(p)
            merged += 1
        g = edits.Graph(sorted(e))
        edits.merge_equivalent(g, todo, "n00", {}, set())
        assert set(g.edges()) == want and not error
    assert merged > 60


def test_type_check(spark, lean):
    types = spark.createDataFrame([("i", "G"), ("j", "F")], "inst string, cls string")
    cons = spark.createDataFrame([("p", "subject", "C"), ("p", "object", "F"), ("q", "subject", "B")], "property string, side string, type string")
    rows = [("i", "p", "j"), ("j", "p", "i"), ("i", "p", "i"), ("k", "p", "j"), ("i", "r", "z"), ("i", "p", '"lit"'), ("k", "p", "z"), ("k", "q", "z")]
    f = spark.createDataFrame(rows, "s string, p string, o string")
    got = {(r["s"], r["p"], r["o"]): r["verdict"] for r in facts.check_facts(f, types, closure(lean), cons).collect()}
    want = ["ok", "domain_constraint_not_satisfied", "range_constraint_not_satisfied", "no_types_for_subject", "ok", "ok", "no_types_for_subject", "no_types_for_subject"]
    assert [got[r] for r in rows] == want
    double = {(r["s"], r["p"], r["o"]): r["reason"] for r in facts.double_failures(f, types, closure(lean), cons).collect()}
    assert double == {("k", "p", "z"): "no_types_for_domain_and_range", ("j", "p", "i"): "both_domain_and_range_constraint_not_satisfied"}


def test_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v long")
    assert stats.upper_median(df, "v").first()["median"] == 3
    assert stats.upper_median(df.filter(F.col("v") < 4), "v").first()["median"] == 2


def test_sampled_measures_cover_all(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    exact = {r["grp"]: (r["n"], r["intruders"], r["robustness"]) for r in entry.queries()["kg_robustness"](spark, sf).collect()}
    got = entry.queries()["kg_robustness_sampled"](spark, sf).collect()
    assert {r["grp"]: (r["n"], r["intruders"], r["robustness"]) for r in got} == exact
    assert {(r["rounds"], r["std"]) for r in got} == {(1, 0.0)}
    v = spark.createDataFrame([(i, i % 3, [float(i % 5), 1.0, float(i % 7)]) for i in range(60)], "node long, grp long, vec array<double>")
    some = evaluation.sampled_robustness(v.select("grp", "node"), v.select("node", "vec"), rounds=3, sample=20)
    assert {r["rounds"] for r in some.collect()} == {3}
    tau = entry.queries()["kg_csc_sampled"](spark, sf).first()
    assert tau["rounds"] == 1 and tau["std_tau"] == 0.0
    x, y = np.random.default_rng(3).integers(0, 9, (2, 200)).astype(float)
    s = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(200) for j in range(i)]
    want = sum(a * b for a, b in s) / np.sqrt(sum(a != 0 for a, _ in s) * sum(b != 0 for _, b in s))
    assert abs(evaluation.kendall_tau_b(x, y) - want) < 1e-12


def test_sampled_robustness_is_its_sql_beyond_a_sample(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 3).tolist(), i % 4) for i in range(10_040)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    exact = {r["grp"]: r for r in entry.queries()["kg_robustness"](spark, f"file://{tmp_path}").collect()}
    got = entry.queries()["kg_robustness_sampled"](spark, f"file://{tmp_path}").collect()
    assert len(got) == 4 and all(r["rounds"] == 1 and r["std"] == 0.0 and r["intruders"] == exact[r["grp"]]["intruders"] for r in got)


def test_classes_above_are_counted_by_sets_of_classes(spark):
    from taxoforge.operators import stats
    from taxoforge.operators.closure import closure, root_paths

    edges = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "a"), ("c", "b")], "child string, parent string")
    types = spark.createDataFrame([("1", "c"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "b"), ("3", "a"), ("4", "none"), ("5", None)], "inst string, cls string")
    out = stats.class_expansion(types.select("inst").distinct(), types, closure(edges), root_paths(edges, "r"))
    r = out.first()
    assert r["avg_classes"] == (4 + 3 + 3) / 5 and r["avg_paths"] == 7 / 5
    assert "inst" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "anc" in x)  # no row for an instance and a class


def test_exact_edit_distance():
    d = graph.exact_edit_distance
    m = [(c, p) for c, p in M1]
    assert d(m, m) == 0 and d(m, [x for x in m if x != ("D", "A")]) == 1
    assert d([("a", "b")], [("a", "c")]) == 1  # one name for another, where the set distance counts both nodes and edges
    assert d([("a", "b")], [("x", "y")]) == 2 and d([("a", "b")], [("b", "a")]) == 2 and d([], [("x", "y")]) == 3
    rng = np.random.default_rng(2)
    for _ in range(25):
        make = lambda s: sorted({(s[i], s[int(rng.integers(0, i))]) for i in range(1, 4)})
        a, b = make("abcd"), make("abxy")

        def brute(a, b):
            na, nb = sorted({x for e in a for x in e}), sorted({x for e in b for x in e})
            best = 99
            for image in itertools.product([None, *nb], repeat=len(na)):
                used = [y for y in image if y]
                if len(set(used)) == len(used):
                    m = dict(zip(na, image))
                    moved = {(m[c], m[p]) for c, p in a if m[c] and m[p]}
                    cost = sum(x != y for x, y in m.items()) + len(nb) - len(used) + len(a) - len(moved & set(b)) + len(set(b) - moved)
                    best = min(best, cost)
            return best

        assert d(a, b) == brute(a, b)
    with pytest.raises(ValueError):
        d([(f"a{i}", "r") for i in range(9)], [(f"b{i}", "r") for i in range(9)])
