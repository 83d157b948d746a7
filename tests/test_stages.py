"""The stages and the sequential kernels against plain-Python runs of their rules on small random graphs."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from taxoforge.operators import constraints as con
from taxoforge.operators import evaluation, judge
from taxoforge.operators.closure import closure, depths, nodes_of, strict_closure
from taxoforge.plans import stages

# ---- plain rules over a set of edges (child, parent) ----------------------------------------------------------------


def ups(e, x):
    return {p for c, p in e if c == x}


def downs(e, x):
    return {c for c, p in e if p == x}


def above(e, x):
    seen, todo = set(), [x]
    while todo:
        y = todo.pop()
        if y not in seen:
            seen.add(y)
            todo += ups(e, y)
    return seen


def depth_of(e, root):
    out, layer, n = {root: 0}, {root}, 0
    while layer:
        n += 1
        layer = {c for p in layer for c in downs(e, p)} - set(out)
        out |= dict.fromkeys(layer, n)
    return out


def reduced(e):
    left = set(e)
    for c, p in sorted(e):
        if any(p in above(left - {(c, p)}, q) for q in ups(left, c) - {p}):
            left.discard((c, p))
    return left


def ordered(e, root, sim, reverse=False):
    level = depth_of(e, root)
    rows = [x for n in range(max(level.values()) + 1) for x in sorted((x for x in e if level[x[1]] == n), key=lambda x: (len(ups(e, x[0])), x[0], x[1]), reverse=True)]
    out = []
    for _, run in itertools.groupby(rows, key=lambda x: (len(ups(e, x[0])), x[0])):
        out += sorted(run, key=lambda x: -sim[x] if reverse else sim[x])
    return out


def refine(e, verdict, judged, sim, counts, mapped, root, max_depth=3):
    e, counts, merged = set(e), dict(counts), {}
    for c, p in ordered(e, root, sim):  # cut
        if (c, p) in e and verdict[c, p] == "[IRRELEVANT]":
            e.discard((c, p))
            if not ups(e, c):
                lost, layer, seen = [c], {c}, {c}
                while True:
                    layer = {k for x in layer for k in downs(e, x)} - seen
                    seen |= layer
                    new = [k for k in sorted(layer) if root not in above(e, k)]
                    lost += new
                    if not new or len(lost) > 3:
                        break
                if len(lost) <= 3:
                    e = {(x, y) for x, y in e if x not in lost and y not in lost}
                    for x in lost:
                        counts.pop(x, None)
                else:
                    e.add((c, p))
    for c, p in ordered(e, root, sim):  # resolve
        if p != root and (c, p) in e and verdict.get((c, p)) == "[REVERSE]":
            if len(ups(e, c)) > 1:
                e.discard((c, p))
            else:
                e = {(x, p if y == c else y) for x, y in e if x != c}
                merged[c] = p
                counts[p] = counts.get(p, 0) + counts.pop(c, 0)
    e = reduced(e)
    fine = []
    for c, p in ordered(e, root, sim, True):  # valid merges
        if p != root and verdict.get((c, p)) == "[EQUIVALENT]":
            ok = True
            for q in ups(e, c) - {p}:
                if q not in above(e, p):
                    ok &= judged(p, q) and all(judged(p, h) for h in ups(e, q) if h not in above(e, p))
            fine += [(c, p)] * ok
    used = set(merged.values())
    for c, p in fine:  # merge
        if (c, p) in e and c not in used and p not in used:
            e = reduced({(x, p if y == c else y) for x, y in e if x != c} | {(p, q) for q in ups(e, c) - {p}})
            merged[c] = p
            used.add(p)
            counts[p] = counts.get(p, 0) + counts.pop(c, 0)
    while True:  # contract
        nodes = {x for y in e for x in y}
        gone = sorted(x for x in nodes if len(ups(e, x)) == 1 and len(downs(e, x)) == 1 and counts.get(x, 0) < 1)
        if not gone:
            break
        for x in gone:
            (p,), (c,) = ups(e, x), downs(e, x)
            e = {y for y in e if x not in y}
            if p not in above(e, c):
                e.add((c, p))
    e = reduced(e)
    tops = sorted(downs(e, root))
    for t in tops:
        if all(ups(e, c) - set(tops) for c in downs(e, t)):
            e = {x for x in e if t not in x}
    live = {x for x in {y for z in e for y in z} if root in above(e, x)}
    e = {x for x in e if set(x) <= live}
    nodes = {x for y in e for x in y}
    rich = {x for x in nodes if sum(n for k, n in counts.items() if k in nodes and x in above(e, k)) >= 1}
    e = {x for x in e if set(x) <= rich}
    near = {x for x, n in depth_of(e, root).items() if n <= max_depth}
    kept = (mapped & {x for y in e for x in y}) | near

    def first(x):
        return {q for p in ups(e, x) for q in ({p} if p in kept else first(p))}

    return reduced({(x, p) for x in kept for p in first(x)}), merged


@pytest.mark.parametrize("seed", [1, 2])
def test_refined_taxonomy_by_plain_rules(spark, seed):
    rng = np.random.default_rng(seed)
    n = 40
    name = [f"n{i:02d}" for i in range(n)]
    e = sorted({(name[i], name[int(rng.integers(0, max(1, i * 2 // 3)))]) for i in range(1, n) for _ in range(int(rng.integers(1, 3)))})
    root = name[0]
    kinds = ["[SUBSUME]", "[IRRELEVANT]", "[REVERSE]", "[EQUIVALENT]"]
    said = {"[SUBSUME]": ("True", "False"), "[IRRELEVANT]": ("False", "False"), "[REVERSE]": ("False", "True"), "[EQUIVALENT]": ("True", "True")}
    verdict = {x: kinds[int(rng.choice(4, p=[0.6, 0.12, 0.1, 0.18]))] for x in e}
    sim = {(a, b): float(rng.integers(0, 5)) for a in name for b in name}
    counts = {x: int(rng.integers(0, 3)) for x in name[5:] if rng.random() < 0.7}
    mapped = {x for x in name if rng.random() < 0.6}
    judged = lambda p, q: (int(p[1:]) * 3 + int(q[1:])) % 4 > 0
    edges = spark.createDataFrame(e, "child string, parent string")
    p = spark.createDataFrame([(m, c, q, q, c, *said[verdict[c, q]], 0.9, 0.8) for m in ("m1", "m2", "m3") for c, q in e], "model string, child string, parent string, plabel string, clabel string, answer string, answer_inverse string, confidence double, confidence_inverse double")
    s = spark.createDataFrame([(*x, v) for x, v in sim.items()], "child string, parent string, sim double")
    k = spark.createDataFrame(list(counts.items()), "cls string, cnt long")
    answers = spark.createDataFrame([(a, b, judged(a, b), 0.9) for a in name for b in name], "a string, b string, ok boolean, conf double")
    m = spark.createDataFrame([(x,) for x in sorted(mapped)], "node string")
    want, merged = refine(e, verdict, judged, sim, counts, mapped, root)
    got = stages.refine_taxonomy(edges, p, answers, s, k, m, root)
    assert {tuple(r) for r in got.final.select("child", "parent").collect()} == want
    assert {tuple(r) for r in got.mapping.collect()} == set(merged.items())
    assert len(want) > 8 and merged


def test_linkage_by_its_definition():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        d = rng.random((n, n)) + 0.01
        d = d + d.T
        np.fill_diagonal(d, 0)
        groups, heights = [[i] for i in range(n)], []
        while len(groups) > 1:
            h, i, j = min((np.mean([d[a, b] for a in groups[i] for b in groups[j]]), i, j) for i in range(len(groups)) for j in range(i))
            heights.append(h)
            groups = [g for x, g in enumerate(groups) if x not in (i, j)] + [groups[i] + groups[j]]
        merges, got = con.linkage(d)
        assert np.allclose(got, heights) and sorted(merges[-1][0] + merges[-1][1]) == list(range(n))
        t = con.max_gap(got)
        label = con.flat_clusters(d)
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (a, b), h in zip(merges, got):
            if h <= t:
                parent[find(a[0])] = find(b[0])
        assert all((label[i] == label[j]) == (find(i) == find(j)) for i in range(n) for j in range(n))


def test_choice_by_its_rules():
    """Every round takes the candidate that covers most open types, then the best by information and nearness."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        types = [f"t{i}" for i in range(6)]
        below = {t: {t: int(rng.integers(0, 5)), f"{t}x": int(rng.integers(0, 3))} for t in types}
        options = []
        for i in range(5):
            own = [t for t in types if rng.random() < 0.5]
            options.append({"anc": f"a{i}", "dist": {t: int(rng.integers(1, 4)) for t in own}, "n_all": 20, "c_all": int(rng.integers(5, 40)), "above": {f"a{j}" for j in range(i) if rng.random() < 0.15}})
        total = 60
        open_, want, left = {t for o in options for t in o["dist"]}, [], list(options)

        def ic(c):
            return -np.log(c / total) if 0 < c < total else 0.0

        while True:
            ranked = []
            for o in left:
                own = sorted(set(o["dist"]) & open_)
                if len(own) > 1:
                    sub = ic(sum(sum(below[t].values()) for t in own))
                    gain = (1.0 if ic(o["c_all"]) == 0 else 0.0) if sub == 0 else ic(o["c_all"]) - sub
                    near = np.mean([o["dist"][t] for t in own])
                    if gain >= -0.1 and near <= 2:
                        ranked.append((len(own), gain, -near, o["anc"], own, o))
            if not ranked:
                break
            best = max(ranked, key=lambda x: x[:3])
            best = min((x for x in ranked if x[:3] == best[:3]), key=lambda x: x[3])
            want.append((best[3], best[4]))
            open_ -= set(best[4])
            left.remove(best[5])
        got = con.choose(options, below, total)
        over = {o["anc"]: o["above"] for o in options}
        names = [a for a, _ in want]
        assert [x for x in want if x in got] == got  # what is kept was chosen, in the order of choice
        for a in names:
            if a not in [x for x, _ in got]:
                assert any(b in over[a] or a in over[b] for b in names if b != a)
        for (a, _), (b, _) in itertools.combinations(got, 2):
            assert a not in over[b] and b not in over[a]


def test_cleaned_constraints_by_hand(spark):
    # two families under E: A over a1, a2, a3; B over b1, b2; A and B are tops, P and Q stand between
    e = spark.createDataFrame([("A", "E"), ("B", "E"), ("P", "A"), ("a1", "P"), ("a2", "P"), ("a3", "A"), ("Q", "B"), ("b1", "Q"), ("b2", "Q")], "child string, parent string")
    counts = spark.createDataFrame([("a1", 5), ("a2", 5), ("a3", 50), ("b1", 4), ("b2", 6)], "cls string, cnt long")
    c = spark.createDataFrame([("p", "subject", t) for t in ("a1", "a2", "b1", "b2", "gone", "old")], "property string, side string, type string")
    mapping = spark.createDataFrame([("old", "a1")], "src string, dst string")
    got = con.clean_constraints(c, mapping, e, counts, closure(e), "E")
    assert {(r["type"], r["origin"]) for r in got.collect()} == {("P", "ancestor"), ("Q", "ancestor")}
    one = con.clean_constraints(c.filter("type in ('a1', 'b1')"), mapping, e, counts, closure(e), "E")
    assert {(r["type"], r["origin"]) for r in one.collect()} == {("a1", "type"), ("b1", "type")}


# ---- measures ----------------------------------------------------------------------------------------------------


def test_correlation_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n = 60
    e = sorted({(f"n{i}", f"n{int(rng.integers(0, i))}") for i in range(1, n) for _ in range(2)})
    edges = spark.createDataFrame(e, "child string, parent string")
    vec = {f"n{i}": rng.integers(-2, 3, 3).astype(float) for i in range(n) if i % 7}
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in vec.items()], "node string, vec array<double>")
    deep = depth_of(set(e), "n0")
    x, y = [], []
    for a, b in itertools.combinations(sorted(vec), 2):
        both = (above(e, a) - {a}) & (above(e, b) - {b})
        x.append(round(float(vec[a] @ vec[b]), 9))
        y.append(round(2 * max((deep[u] + 1 for u in both), default=0) / (deep[a] + deep[b] + 2), 9))
    x, y = np.array(x), np.array(y)
    i, j = np.triu_indices(len(x), 1)
    want = (np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])).sum() / np.sqrt(float((x[i] != x[j]).sum()) * (y[i] != y[j]).sum())
    strict, depth = strict_closure(edges), depths(edges, "n0")
    pairs = evaluation.similarity_pairs(*evaluation.node_blocks(nodes_of(edges), strict, depth, vectors, block_nodes=13))
    assert Counter((r["x"], r["y"]) for r in pairs.collect()) == Counter(zip(x.tolist(), y.tolist()))
    for part in (1 << 20, 100):
        got = evaluation.tau_b(pairs, part)
        assert got[0] == len(x) and abs(got[1] - want) < 1e-12
    r = evaluation.concept_correlation(nodes_of(edges), vectors, strict, depth).first()
    assert r["n"] == len(x) and abs(r["tau"] - want) < 1e-12
    hist = {r["sim"]: r["pairs"] for r in evaluation.similarity_histogram(nodes_of(edges).filter("node not in ('n0', 'n7', 'n14', 'n21', 'n28', 'n35', 'n42', 'n49', 'n56')"), strict, depth).collect()}
    assert hist == Counter(round(v, 6) for v in y)


def test_groups_in_blocks(spark):
    rng = np.random.default_rng(4)
    v = {i: rng.normal(size=4) for i in range(70)}
    group = defaultdict(list)
    for i in v:
        group["abcdef"[int(rng.integers(0, 5))]].append(i)
    group["z"] = [3]
    groups = spark.createDataFrame([(g, i) for g, own in group.items() for i in own], "grp string, node long")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "node long, vec array<double>")
    got = {r["grp"]: r for r in evaluation.robustness(groups, vectors, block_rows=7).collect()}
    assert set(got) == {g for g, own in group.items() if len(own) > 1}
    for g, r in got.items():
        own = group[g]
        low = min(v[a] @ v[b] for a, b in itertools.combinations(own, 2))
        out = sum(v[a] @ v[b] > low + 1e-12 for a in own for b in v if b not in own)
        assert (r["n"], r["intruders"]) == (len(own), out) and abs(r["cohesion"] - low) < 1e-12
        assert abs(r["robustness"] - (1 - out / (len(own) * (70 - len(own))))) < 1e-12


def test_label_vectors_by_hand(spark):
    labels = {"a": "Red House", "b": "house", "c": "", "d": None}
    df = spark.createDataFrame(list(labels.items()), "node string, label string")
    for r in judge.embed_labels(df, dim=8).collect():
        words = (labels[r["node"]] or "").lower().split() or [""]
        v = np.mean([judge.hashed_token_vector(w, 8) for w in words], axis=0)
        assert np.allclose(r["vec"], v / np.linalg.norm(v))


def test_facts_stage_by_hand(spark):
    # E over A and B, a1 under A, b1 under B; "old" was merged into a1; p takes A to B
    e = spark.createDataFrame([("A", "E"), ("B", "E"), ("a1", "A"), ("b1", "B")], "child string, parent string")
    none = spark.createDataFrame([], "stage string, step int, op string, child string, parent string")
    taxonomy = stages.Taxonomy(e, e, spark.createDataFrame([("old", "a1")], "src string, dst string"), none)
    typed = {"x": ["old"], "y": ["b1", "B"], "z": ["a1"], "u": ["a1"], "w": ["none"]}
    rows = [(s, "wdt:P31", o) for s, os in typed.items() for o in os] + [(s, "rdfs:label", '"n"@en') for s in typed if s != "u"]
    rows += [("x", "p", "y"), ("z", "p", "x"), ("y", "p", "y"), ("u", "p", "y"), ("x", "q", '"lit"@de'), ("x", "q", '"lit"@en'), ("z", "p", "y"), ("w", "p", "y"), ("y", "p", "z")]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    c = spark.createDataFrame([("p", "subject", "A"), ("p", "subject", "E2"), ("p", "object", "B")], "property string, side string, type string")
    classes = spark.createDataFrame([(x,) for x in ("E", "A", "B", "a1", "b1", "old")], "cls string")
    nothing = spark.createDataFrame([], "x string")
    out = stages.build_facts(t, taxonomy, c, classes, nothing, nothing, "E")
    got = {k: {tuple(r) for r in v.collect()} for k, v in out.items()}
    assert got["types"] == {("x", "a1"), ("y", "b1"), ("z", "a1")}
    labels = {(s, "rdfs:label", '"n"@en') for s in "xyzw"}  # labels are facts too
    assert got["facts"] == {("x", "p", "y"), ("z", "p", "y"), ("x", "q", '"lit"@en')} | labels
    assert {(s, v) for s, _, _, v in got["check_log"]} == {("z", "range_constraint_not_satisfied"), ("y", "domain_constraint_not_satisfied"), ("w", "no_types_for_subject")}
    assert {("y", "p", "y", "rare_facts_s_o_equal"), ("u", "p", "y", "non_labeled_subject_or_object"), ("x", "q", '"lit"@de', "silent:language")} <= got["fact_log"]
    assert ("u", "wdt:P31", "a1", "instance_no_label") in got["type_log"] and ("y", "wdt:P31", "B", "is_a_shortcut") in got["type_log"] and ("w", "wdt:P31", "none", "type_none_not_a_valid_class") in got["type_log"]
    assert got["constraints"] == {("p", "subject", "A"), ("p", "object", "B")}
