"""Type checks kept up under changes, against a fresh check by plain Python."""

import random

from taxoforge.operators import checks
from taxoforge.operators.closure import closure

T, R, A = "inst string, cls string", "property string, side string, type string", "s string, p string, o string"
EDGES = {("A", "R"), ("B", "R"), ("C", "B"), ("C", "A"), ("D", "C"), ("E", "B")}


def above(c):
    out, todo = {c}, [c]
    for x in todo:
        todo += [b for a, b in EDGES if a == x and b not in out]
        out |= {b for a, b in EDGES if a == x}
    return out if any(c in e for e in EDGES) else set()


def by_hand(types, rules, facts):
    """verdicts and uses of sets of types, rules and facts."""
    hits = {(p, side, t, i) for i, c in types for p, side, t in rules if t in above(c)}
    fits, typed, has = {(p, s, i) for p, s, _, i in hits}, {i for i, _ in types}, {(p, s) for p, s, _ in rules}

    def verdict(s, p, o):
        for side, word, x in (("subject", "domain", s), ("object", "range", o)):
            if (p, side) in has and not (side == "object" and x.startswith('"')):
                if x not in typed:
                    return f"no_types_for_{side}"
                if (p, side, x) not in fits:
                    return f"{word}_constraint_not_satisfied"
        return "ok"

    verdicts = {f: verdict(*f) for f in facts}
    kept = [f for f, v in verdicts.items() if v == "ok" and f[1] != "wdt:P106"]
    used = {r: sum((r[0], r[1], r[2], f[0] if r[1] == "subject" else f[2]) in hits for f in kept if f[1] == r[0]) for r in rules}
    return verdicts, used


def pick(rnd, what):
    i = f"i{rnd.randrange(14)}"
    if what is T:
        return (i, rnd.choice("ABCDERX"))
    if what is R:
        return (rnd.choice(["p", "q", "wdt:P106"]), rnd.choice(["subject", "object"]), rnd.choice("ABCR"))
    return (i, rnd.choice(["p", "q", "free", "wdt:P106"]), rnd.choice([f"i{rnd.randrange(14)}", '"text"@en', "wd:untyped"]))


def compare(state, types, rules, facts, before):
    verdicts, used = by_hand(types, rules, facts)
    assert {tuple(r) for r in state.types.collect()} == types and {tuple(r) for r in state.rules.collect()} == rules
    got = state.facts.select("s", "p", "o", "verdict").collect()
    assert len(got) == len(verdicts) and {tuple(r[:3]): r[3] for r in got} == verdicts
    assert {tuple(r[:3]): r[3] for r in state.usage.select("property", "side", "type", "used").collect()} == used
    moved = {f: (before.get(f), verdicts.get(f)) for f in before.keys() | verdicts.keys() if before.get(f) != verdicts.get(f)}
    changed = state.changed.select("s", "p", "o", "before", "after").collect()
    assert len(changed) == len(moved) and {tuple(r[:3]): tuple(r[3:]) for r in changed} == moved
    return verdicts


def test_changes_give_the_verdicts_and_uses_of_a_fresh_check(spark):
    rnd = random.Random(5)
    full = closure(spark.createDataFrame(sorted(EDGES), "child string, parent string")).cache()
    sets = {w: {pick(rnd, w) for _ in range(n)} for w, n in ((T, 18), (R, 6), (A, 90))}
    given = [spark.createDataFrame([*sorted(sets[w]), sorted(sets[w])[0]], w) for w in (T, R, A)]
    state = checks.checked(full, *given)
    verdicts = compare(state, sets[T], sets[R], sets[A], {})
    assert len(set(verdicts.values())) >= 4
    for n in (0, 2, 8):
        frames = []
        for w, many in ((T, n), (R, n // 3), (A, 2 * n)):
            gone = {rnd.choice(sorted(sets[w])) for _ in range(many)} | {pick(rnd, w)} if n else set()
            come = {pick(rnd, w) for _ in range(many)} | set(list(gone)[:1])
            rows = [(*x, -1) for x in gone] + [(*x, 1) for x in come] + [(*x, 1) for x in come][:2]
            rows += [(None, *x[1:], 1) for x in list(come)[:1]]
            sets[w] = (sets[w] - gone) | come
            frames.append(spark.createDataFrame(rows, w + ", change int"))
        state = checks.apply_changes(state, full, *frames)
        verdicts = compare(state, sets[T], sets[R], sets[A], verdicts)
    hits = {tuple(r[:4]): r[4] for r in state.hits.select("property", "side", "type", "inst", "n").collect()}
    want = {}
    for i, c in sets[T]:
        for p, side, t in sets[R]:
            if t in above(c):
                want[p, side, t, i] = want.get((p, side, t, i), 0) + 1
    assert hits == want and max(want.values()) > 1


def test_everything_may_go_and_come_back(spark):
    full = closure(spark.createDataFrame(sorted(EDGES), "child string, parent string"))
    types, rules, facts = {("i1", "D"), ("i2", "E")}, {("p", "subject", "A"), ("p", "object", "B")}, {("i1", "p", "i2"), ("i2", "p", "i1")}
    state = checks.checked(full, *(spark.createDataFrame([], w) for w in (T, R, A)))
    verdicts = compare(state, set(), set(), set(), {})
    for sign in (1, -1):
        frames = [spark.createDataFrame([(*x, sign) for x in rows], w + ", change int") for rows, w in ((types, T), (rules, R), (facts, A))]
        state = checks.apply_changes(state, full, *frames)
        verdicts = compare(state, *((types, rules, facts) if sign > 0 else (set(), set(), set())), verdicts)


def test_few_flips_and_many_give_the_same(spark, monkeypatch):
    """All facts checked again, or only those that rest on what flipped; with uses kept and without."""
    rnd = random.Random(8)
    full = closure(spark.createDataFrame(sorted(EDGES), "child string, parent string")).cache()
    sets = {w: {pick(rnd, w) for _ in range(n)} for w, n in ((T, 18), (R, 6), (A, 90))}
    state = checks.checked(full, *(spark.createDataFrame(sorted(sets[w]), w) for w in (T, R, A)))
    bare = checks.checked(full, *(spark.createDataFrame(sorted(sets[w]), w) for w in (T, R, A)), uses=False)
    before, _ = by_hand(sets[T], sets[R], sets[A])
    frames = []
    for w, many in ((T, 5), (R, 2), (A, 9)):
        gone = {rnd.choice(sorted(sets[w])) for _ in range(many)}
        come = {pick(rnd, w) for _ in range(many)}
        frames.append(spark.createDataFrame([(*x, -1) for x in gone] + [(*x, 1) for x in come], w + ", change int"))
        sets[w] = (sets[w] - gone) | come
    for parts in (0, 10**6):
        monkeypatch.setattr(checks, "FLIPPED_PARTS", parts)
        compare(checks.apply_changes(state, full, *frames), sets[T], sets[R], sets[A], before)
        plain = checks.apply_changes(bare, full, *frames)
        assert plain.mentions is None and plain.usage is None
        verdicts, _ = by_hand(sets[T], sets[R], sets[A])
        assert {tuple(r[:3]): r[3] for r in plain.facts.select("s", "p", "o", "verdict").collect()} == verdicts


def shuffled_rows(spark):
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_facts_travel_few_times_however_much_flips(spark):
    full = closure(spark.createDataFrame(sorted(EDGES), "child string, parent string")).cache()
    n = 40_000
    facts = spark.range(n).selectExpr(f"concat('a', id % {n // 8}) AS s", "'p' AS p", f"concat('b', id % {n // 8 - 1}) AS o")
    types = spark.range(n // 8).selectExpr("concat('a', id) AS inst", "'A' AS cls").unionAll(spark.range(n // 8).selectExpr("concat('b', id)", "'C'"))
    rules = spark.createDataFrame([("p", "subject", "B"), ("p", "object", "B")], R)
    state = checks.checked(full, types, rules, facts, uses=False)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = shuffled_rows(spark)
        changed = [spark.createDataFrame([("p", "subject", "A", 1), ("p", "object", "B", -1)], R + ", change int"), spark.createDataFrame([("x", "p", "y", 1)], A + ", change int")]
        after = checks.apply_changes(state, full, spark.createDataFrame([], T + ", change int"), *changed)
        assert after.facts.filter("verdict = 'ok'").count() == n
        moved = sum(rows for stage, rows in shuffled_rows(spark).items() if stage not in old)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert moved < 10 * n, moved
