"""Small graphs cost a job per table that is written: how many tables the loops over a class graph write."""

from taxoforge.operators import closure, graph, scc


def _counted(monkeypatch, *modules):
    made = []
    for m in modules:
        write = m.stash
        monkeypatch.setattr(m, "stash", lambda df, tag, write=write: made.append(tag) or write(df, tag))
    return made


def test_four_levels_take_one_round(spark, monkeypatch):
    e = spark.createDataFrame([("a", "r"), ("b", "a"), ("c", "b"), ("d", "c"), ("d", "a")], "child string, parent string")
    made = _counted(monkeypatch, closure)
    assert sorted(map(tuple, closure.depths(e, "r").collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 2), ("r", 0)]
    assert len(made) == 3  # the steps, the nearest, one round
    made.clear()
    assert ("d", "r", 2) in set(map(tuple, closure.strict_closure(e).collect())) and len(made) == 2


def test_validation_writes_what_it_reads_again_only(spark, monkeypatch):
    e = spark.createDataFrame([("a", "r"), ("b", "a"), ("c", "b"), ("d", "c"), ("d", "a")], "child string, parent string")
    made = _counted(monkeypatch, closure, graph)
    assert tuple(graph.validate(e).first()) == (5, 5, 1, True, True)
    assert sorted(made) == ["edges", "peeled", "reach", "reach"]
    bad = e.union(spark.createDataFrame([("a", "d"), ("x", "y")], "child string, parent string"))
    assert tuple(graph.validate(bad).first()) == (7, 7, 2, False, False)


def test_long_cycles_are_still_found(spark):
    ring = [(f"n{i:02}", f"n{(i + 1) % 30:02}") for i in range(30)]
    e = spark.createDataFrame([*ring, ("x", "n03"), ("n04", "y")], "child string, parent string")
    assert {tuple(r) for r in scc.strong_components(e).collect()} == {(c, "n00") for c, _ in ring}
