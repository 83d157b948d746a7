"""Labels, closures kept up under edits, components, clustering and pruned products, each against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoforge.operators import constraints as con
from taxoforge.operators import evaluation, graph, labels, maintain, ordering, scc
from taxoforge.operators.closure import closure

EDGE = "child string, parent string"


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), EDGE)


def reached(edges):
    """node: {ancestor or itself: least distance}."""
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
        up.setdefault(b, set())
    out = {}
    for n in up:
        dist, todo = {n: 0}, [n]
        for x in todo:
            for y in up[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
        out[n] = dist
    return out


def random_edges(rnd, n, m, cyclic):
    out = set()
    while len(out) < m:
        a, b = rnd.sample(range(n), 2)
        out.add((f"n{a}", f"n{b}") if cyclic or a > b else (f"n{b}", f"n{a}"))
    return out


@pytest.mark.parametrize("cyclic", [False, True])
def test_labels_answer_as_the_closure(spark, cyclic):
    rnd = random.Random(3)
    edges = random_edges(rnd, 40, 75, cyclic)
    want = reached(edges)
    got = labels.reach_labels(frame(spark, edges).unionByName(frame(spark, list(edges)[:5] + [("n1", "n1")]))).cache()
    asked = [(f"n{a}", f"n{b}") for a in range(-1, 41) for b in range(-1, 41)]
    yes = {tuple(r) for r in labels.has_path(spark.createDataFrame(asked * 2, EDGE), got).collect()}
    assert yes == {(a, b) for a, d in want.items() for b in d}
    degree = {n: [0, 0] for n in want}
    for a, b in edges:
        degree[a][0] += 1
        degree[b][1] += 1
    rank = {n: ((x + 1) * (y + 1), n) for n, (x, y) in degree.items()}
    canonical = set()
    for a, d in want.items():
        for b in d:
            top = max((z for z in d if b in want[z]), key=rank.get)
            canonical |= {("out", a, b)} if top == b else set()
            canonical |= {("in", b, a)} if top == a else set()
    assert {(r["side"], r["node"], r["hub"]) for r in got.collect()} == canonical
    assert got.count() == len(canonical)


def test_labels_are_fewer_than_closure_rows(spark):
    """A hub between two layers: its ends need one label each, the closure all pairs."""
    edges = [(f"a{i}", "hub") for i in range(60)] + [("hub", f"z{i}") for i in range(60)]
    got = labels.reach_labels(frame(spark, edges))
    assert got.count() <= 4 * 121 < closure(frame(spark, edges)).count() / 7


def test_subclass_of_any_by_labels(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "c"), ("e", "f")]
    got = labels.subclass_of_any(
        spark.createDataFrame([("k", x) for x in "abcdefq"] + [("m", "a"), ("k", "a")], "key string, cls string"),
        labels.reach_labels(frame(spark, edges)), spark.createDataFrame([("k", "b"), ("k", "f"), ("k", "f"), ("m", "d"), ("k", "none")], "key string, anc string"),
    )
    assert sorted(tuple(r) for r in got.collect()) == [("k", "a"), ("k", "b"), ("k", "e"), ("k", "f")]
    assert labels.reach_labels(frame(spark, [("x", "y")]).limit(0)).count() == 0


@pytest.mark.parametrize("cyclic, seed", [(False, 1), (True, 2), (True, 5)])
def test_closure_after_edits_equals_a_fresh_one(spark, cyclic, seed):
    rnd = random.Random(seed)
    edges = random_edges(rnd, 30, 60, cyclic)
    gone = set(rnd.sample(sorted(edges), 8)) | {("n1", "nowhere")}
    come = random_edges(rnd, 36, 8, cyclic) | set(rnd.sample(sorted(edges), 2)) | {rnd.choice(sorted(gone & edges)), ("n3", "n3")}
    before = frame(spark, edges)
    m = maintain.maintain_closure(closure(before).cache(), before, frame(spark, gone), frame(spark, come))
    after = (edges - gone) | {e for e in come if e[0] != e[1]}
    want = {(a, b, d) for a, own in reached(after).items() for b, d in own.items()}
    rows = [tuple(r) for r in m.full.select("node", "anc", "dist").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert {tuple(r) for r in m.edges.collect()} == after
    was = {(a, b, d) for a, own in reached(edges).items() for b, d in own.items()}
    moved = {(a, b) for a, b, d in was ^ want if a != b}
    assert moved <= {tuple(r) for r in m.changed.collect()}
    assert m.suspects.count() < len(was)
    if not cyclic:
        lean = {tuple(r) for r in graph.transitive_reduction(before).collect()}
        redundant = maintain.maintain_redundant(frame(spark, edges - lean), m) if edges - lean else m.edges.limit(0)
        assert {tuple(r) for r in m.edges.join(redundant, ["child", "parent"], "left_anti").collect()} == {tuple(r) for r in graph.transitive_reduction(frame(spark, after)).collect()}


def test_edits_touch_few_pairs(spark):
    """One edge of many goes and one comes: the rest is carried over."""
    edges = [(f"c{i}", f"p{i % 20}") for i in range(400)] + [(f"p{i}", "root") for i in range(20)]
    before = frame(spark, edges)
    m = maintain.maintain_closure(closure(before).cache(), before, frame(spark, [("c7", "p7")]), frame(spark, [("c8", "p9")]))
    assert {tuple(r) for r in m.suspects.collect()} == {("c7", "p7"), ("c7", "root"), ("c7", "c7")} - {("c7", "c7")}
    assert {tuple(r) for r in m.changed.collect()} == {("c7", "p7"), ("c7", "root"), ("c8", "p9")}
    nothing = maintain.maintain_closure(closure(before).cache(), before, frame(spark, edges).limit(0), frame(spark, edges).limit(0))
    assert nothing.full.count() == closure(before).count() and nothing.changed.isEmpty()


def brute_components(edges):
    far = reached(edges)
    return {(n, min(x for x in d if n in far[x])) for n, d in far.items() if any(n in far[x] for x in d if x != n)}


def test_components_by_brute_force(spark):
    rnd = random.Random(8)
    for n, m in ((25, 30), (40, 70), (12, 11)):
        edges = random_edges(rnd, n, m, True)
        got = [tuple(r) for r in scc.strong_components(frame(spark, edges | {("n2", "n2")})).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_components(edges)
    assert scc.strong_components(frame(spark, random_edges(rnd, 20, 40, False))).count() == 0
    assert scc.strong_components(frame(spark, [("a", "a")])).count() == 0


def test_a_component_of_5000_nodes(spark):
    rnd = random.Random(9)
    names = [f"v{i:05}" for i in rnd.sample(range(5000), 5000)]
    ring = list(zip(names, names[1:] + names[:1]))
    tail = [(f"t{i}", f"t{i + 1}") for i in range(30)] + [("t30", names[0])]
    got = scc.strong_components(frame(spark, ring + tail)).groupBy("scc").count().collect()
    assert [tuple(r) for r in got] == [("v00000", 5000)]


def test_kept_order_finds_loops():
    rnd = random.Random(4)
    for _ in range(60):
        order, up = ordering.AcyclicOrder(), {}
        for _ in range(rnd.randrange(60)):
            a, b = (f"n{rnd.randrange(14)}" for _ in range(2))
            seen, todo = {b}, [b]
            while todo:
                for x in up.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            assert order.add(a, b) == (a not in seen)
            if a not in seen:
                up.setdefault(a, set()).add(b)
            assert all(order.place[x] < order.place[y] for x, ys in up.items() for y in ys)


def test_linkage_takes_ties_by_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        d = rng.integers(1, 4, (n, n)).astype(float)
        d = np.minimum(d, d.T)
        np.fill_diagonal(d, 0)
        if rng.random() < 0.3:
            d[:2, 2:] = d[2:, :2] = np.inf
        cur, groups, want = d.copy(), {i: [i] for i in range(n)}, []
        while len(groups) > 1:
            live = sorted(groups)
            h, a, b = min((cur[i, j], i, j) for i in live for j in live if i < j)
            want.append((groups[a], groups[b], h))
            na, nb = len(groups[a]), len(groups[b])
            cur[a] = cur[:, a] = (na * cur[a] + nb * cur[b]) / (na + nb)
            groups[a] = groups[a] + groups.pop(b)
        merges, heights = con.linkage(d)
        assert [(*m, h) for m, h in zip(merges, heights)] == want


def test_a_property_of_5000_types(spark):
    """50 families of 100 leaves in two halves: ways of 2 inside a family, 6 inside a half, 8 across. The widest gap is that
    from 2 to 6, and merges up to the height after it hold."""
    edges = [("s0", "root"), ("s1", "root")] + [(f"f{i:02}", f"s{i // 25}") for i in range(50)] + [(f"f{i:02}m", f"f{i:02}") for i in range(50)] + [(f"t{i:04}", f"f{i % 50:02}m") for i in range(5000)]
    members = spark.createDataFrame([("p", "subject", f"t{i:04}") for i in range(5000)], "property string, side string, type string")
    got = con.cluster_types(members, closure(frame(spark, edges)))
    assert {(r["chunk"], r["n"]) for r in got.groupBy("chunk").agg(F.count("*").alias("n")).collect()} == {("t0000", 2500), ("t0025", 2500)}


def test_threshold_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, sorted(set(rng.integers(0, 30, rng.integers(1, 9)).astype(float).tolist()))) for i in range(80)] + [(99, [])]
    df = spark.createDataFrame(rows, "id long, hs array<double>")
    for r in df.select("hs", con.gap_threshold("hs").alias("t"), con.list_median("hs").alias("m")).collect():
        assert (r["t"], r["m"]) == ((con.max_gap(r["hs"]), float(np.median(r["hs"]))) if r["hs"] else (None, None))


def brute_robustness(groups, vec):
    out = {}
    for g in {g for g, _ in groups}:
        own = sorted({n for x, n in groups if x == g and n in vec})
        if len(own) < 2:
            continue
        a = np.array([vec[n] for n in own])
        bar = (a @ a.T)[np.triu_indices(len(a), 1)].min()
        rest = np.array([v for n, v in vec.items() if n not in own]).reshape(-1, a.shape[1])
        out[g] = (len(own), round(float(bar), 9), int((a @ rest.T > bar + 1e-12).sum()))
    return out


def test_pruned_products_count_the_same(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (8, 6))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, i % 4, (centres[i % 8] + rng.normal(0, 0.03, 6)).tolist()) for i in range(800)] + [(900, 9, [0.1] * 6)]
    df = spark.createDataFrame(rows, "node long, grp int, vec array<double>").cache()
    groups, vectors = df.select("grp", "node"), df.select("node", "vec")
    got = {r["grp"]: (r["n"], round(r["cohesion"], 9), r["intruders"]) for r in evaluation.robustness(groups, vectors, block_rows=20).collect()}
    vec = {i: v for i, _, v in rows}
    assert got == brute_robustness([(g, i) for i, g, _ in rows], vec)
    work = evaluation.robustness_work(groups, vectors, block_rows=20).first()
    assert work["multiplied"] < work["pairs"] / 2
    one = evaluation.robustness(df.select(F.lit(1).alias("grp"), "node"), vectors, block_rows=30).first()  # all vectors in one group
    assert (one["n"], one["intruders"]) == (801, 0)


def test_blocks_are_sent_to_sides_not_to_every_other_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(evaluation, "GRID", 2)
    for tile, sides in ((1 << 20, 2), (9_000, 5)):
        monkeypatch.setattr(evaluation, "TILE_BYTES", tile)
        rows = [(i, i % 3, rng.normal(0, 1, 8).tolist()) for i in range(600)]
        df = spark.createDataFrame(rows, "node long, grp int, vec array<double>").cache()
        blocks = evaluation.ball_blocks(df.select("node", "vec"), [], 12)
        assert evaluation._sides(blocks, []).first()["sides"] == sides and blocks.count() > 40
        got = {r["grp"]: (r["n"], round(r["cohesion"], 9), r["intruders"]) for r in evaluation.robustness(df.select("grp", "node"), df.select("node", "vec"), block_rows=12).collect()}
        assert got == brute_robustness([(g, i) for i, g, _ in rows], {i: v for i, _, v in rows})


def test_numbers_without_a_single_task(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 7)
    rows = random.Random(3).sample([(i % 9, f"n{i}", i % 4) for i in range(200)], 200)
    df = spark.createDataFrame(rows, "a int, b string, v int").repartition(6)
    got = ordering.running_sum(ordering.numbered(df, [F.desc("a"), F.col("b")], "ord"), "ord", "v", "total").collect()
    total = 0
    for place, (r, want) in enumerate(zip(sorted(got, key=lambda r: r["ord"]), sorted(rows, key=lambda x: (-x[0], x[1]))), 1):
        total += want[2]
        assert (r["ord"], r["a"], r["b"], r["total"]) == (place, want[0], want[1], total)
    assert ordering.numbered(df.limit(0), [F.col("a")], "ord").count() == 0
