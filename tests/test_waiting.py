"""Facts that come before their types, on a stream, against the batch check and by hand."""

import datetime as dt
import random

import pandas as pd

from taxoforge.operators.closure import closure
from taxoforge.operators.facts import check_facts
from taxoforge.plans.check_queries import write_events
from taxoforge.streaming import waiting
from taxoforge.streaming.waiting import EVENT, start_waiting

EDGES = [("A", "R"), ("B", "R"), ("C", "B")]
RULES = [("p", "subject", "A"), ("p", "object", "B"), ("q", "object", "R"), ("r", "subject", "C")]


def run(spark, tmp_path, lateness="10 minutes"):
    full = closure(spark.createDataFrame(EDGES, "child string, parent string"))
    rules = spark.createDataFrame(RULES, "property string, side string, type string")
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    q = start_waiting(events, full, rules, f"file://{tmp_path}/out", f"file://{tmp_path}/log", lateness=lateness)
    assert q.awaitTermination(300) and q.exception() is None
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    return [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("s", "p", "o", "verdict").collect()]


def test_any_order_gives_the_rows_of_the_batch_check(spark, tmp_path):
    types = [(f"i{k}", "ABCRX"[k % 5]) for k in range(20)] + [(f"i{k}", "ABC"[k % 3]) for k in range(10)]
    facts = [(f"i{k % 23}", "pqrz"[k % 4], f"i{k * 7 % 25}" if k % 6 else '"text"@en') for k in range(120)]
    t, f = spark.createDataFrame(types, "inst string, cls string"), spark.createDataFrame(facts + facts[:4], "s string, p string, o string")
    write_events(t, f, f"file://{tmp_path}/in", files=3)
    got = run(spark, tmp_path, "2 hours")
    want = check_facts(f, t, closure(spark.createDataFrame(EDGES, "child string, parent string")), spark.createDataFrame(RULES, "property string, side string, type string"))
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len({v for *_, v in got}) == 5


def test_types_within_the_wait_count_and_later_ones_do_not(spark, tmp_path):
    def at(minute):
        return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)

    def fact(s, p, o, minute):
        return ("fact", None, None, s, p, o, at(minute) if minute is not None else None)

    def type_(i, c, minute):
        return ("type", i, c, None, None, None, at(minute))

    batches = [
        [fact("a", "p", "b", 1), fact("late", "p", '"x"', 1), fact("x", "free", "y", 1), fact("a", None, "b", 1), fact("a", "p", "b", None), fact("o", "q", "never", 2)],
        [type_("a", "A", 50), type_("b", "C", 55), type_(None, "A", 55)],
        [type_("clock", "tick", 300)],
        [type_("clock", "tick", 300)],
        [type_("late", "A", 301)],
        [fact("late", "p", '"y"', 302), type_("clock", "tick", 600)],
        [type_("clock", "tick", 900)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert sorted(run(spark, tmp_path)) == sorted([
        ("a", "p", "b", "ok"), ("late", "p", '"x"', "no_types_for_subject"), ("x", "free", "y", "ok"), ("o", "q", "never", "no_types_for_object"), ("late", "p", '"y"', "ok"),
    ])


class Kept(dict):
    """A state in memory that counts how often it is called."""

    calls = 0

    def getValue(self, k):  # noqa: N802
        Kept.calls += 1
        return dict.get(self, k)

    def updateValue(self, k, v):  # noqa: N802
        Kept.calls += 1
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        Kept.calls += 1
        del self[k]

    def get(self):
        return self.getValue(())

    def update(self, v):
        self.updateValue((), v)


class Handle:
    def __init__(self):
        self.timers = set()
        self.getMapState = self.getValueState = lambda *_: Kept()

    def registerTimer(self, at):  # noqa: N802
        Kept.calls += 1
        self.timers.add(at)


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def test_many_instances_share_a_call_and_each_fact_leaves_at_its_time(monkeypatch):
    """Batches of random types and facts of 3,000 instances in one bucket, against what was said up to each batch."""
    monkeypatch.setattr(waiting, "PACKED", 50)
    rnd, handle = random.Random(3), Handle()
    state = waiting.WaitForTypes(100, "s")
    state.init(handle)
    known, held, Kept.calls = {}, [], 0
    for now in range(0, 700, 50):
        rows = []
        for _ in range(600 if now < 500 else 0):
            i = f"i{rnd.randrange(3000) if rnd.random() < 0.7 else 7}"
            if i != "i7" and rnd.random() < 0.4 or now == 300 and i == "i7":
                rows.append(("type", i, None, None, False, None, rnd.choice([None, ["p"], ["p", "q"]]), 0))
            else:
                rows.append(("fact", i, rnd.choice("pqr"), f"o{len(held)}-{len(rows)}-{now}", rnd.random() < 0.5, "ok" if rnd.random() < 0.1 else None, None, now + rnd.randrange(50)))
        got, want = [], []
        pdf = pd.DataFrame(rows, columns=["kind", "s", "p", "o", "later", "verdict", "allowed", "ms"])
        got += state.handleInputRows((0,), (pdf[k : k + 130] for k in range(0, len(pdf), 130)), Clock(now))
        for kind, i, *_, more, _ in rows:
            if kind == "type":
                known.setdefault(i, set()).update(more or [])
        want += [(*r[1:6], True, True, r[7]) for r in rows if r[0] == "fact" and r[5]]
        held += [(*r[1:5], None, r[7]) for r in rows if r[0] == "fact" and not r[5]]
        for at in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(at)
            got += state.handleExpiredTimer((0,), Clock(now), Clock(at))
        left = []
        for s, p, o, later, v, ms in held:
            fits = p in known.get(s, ())
            if fits or ms + 100 <= now:
                want.append((s, p, o, later, v, s in known, fits, ms))
            else:
                left.append((s, p, o, later, v, ms))
        held = left
        assert sorted(tuple(r) for f in got for r in f.itertuples(index=False)) == sorted(want, key=lambda r: tuple(r)[:3])
    assert not held and not handle.timers and not state.waiting and Kept.calls < 12_000  # of 3,000 instances in 14 batches
