"""A type check and the use of its constraints kept up while types, constraints and facts change.

What is kept is counted: by how many of its types an instance fits an allowed type, how many kept facts mention an instance
on a side. A change adds to and takes from these counts, and only where a count reaches or leaves zero does anything
further follow: facts are given a verdict again if what they rest on flipped, uses are added up from what flipped. Facts meet
their changes in one join and what flipped in one more a side; where much flipped, all facts are checked again without the latter.
Everything is a set: rows that are repeated count once, rows with a null don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.functions.terms import is_literal
from taxoforge.operators.facts import UNCHECKED_PROPERTY, verdicts_by
from taxoforge.scratch import stash

TYPES, RULES, FACTS = ["inst", "cls"], ["property", "side", "type"], ["s", "p", "o"]
SIDE = ["property", "side", "inst"]


@dataclass
class Checked:
    """types (inst, cls), rules (property, side, type) and facts (s, p, o, verdict); hits (property, side, type, inst, n):
    n of the instance's types lie at or below the allowed one; mentions (property, side, inst, n): in n kept facts; usage
    (property, side, type, used); changed (s, p, o, before, after): verdicts of the last change, null where no fact is.
    mentions and usage are None where uses are not kept."""

    types: DataFrame
    rules: DataFrame
    facts: DataFrame
    hits: DataFrame
    mentions: DataFrame | None
    usage: DataFrame | None
    changed: DataFrame


#: Where more than one in this many of the typed instances flipped, all facts are checked again.
FLIPPED_PARTS = 4


def _wish(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: what is both inserted (1) and deleted (-1) is there in the end."""
    return changes.dropna(subset=[*keys, "change"]).groupBy(*keys).agg(F.max(F.signum("change")).cast("int").alias("change"))


def _effective(now: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: the changes that make a difference."""
    wish = _wish(changes, keys)
    there = wish.join(now.select(keys), keys, "left_semi").filter("change < 0")
    return stash(wish.filter("change > 0").join(now.select(keys), keys, "left_anti").unionByName(there), "effective")


def _after(now: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    left = now.select(keys).join(change.filter("change < 0"), keys, "left_anti")
    return stash(left.unionByName(change.filter("change > 0").select(keys)), "after")


def _added(now: DataFrame, change: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts (keys, n) after changes (keys, change) are added, none of them zero; and (keys, flip): 1 for keys that came, -1
    for keys that went."""
    by = stash(change.groupBy(*keys).agg(F.sum("change").cast("long").alias("change")).filter("change <> 0"), "by")
    met = stash(by.join(now, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("had"), (F.coalesce("n", F.lit(0)) + F.col("change")).alias("n")), "met")
    rest = now.join(by.select(keys), keys, "left_anti").select(*keys, "n")
    flips = met.select(*keys, (F.when(F.col("n") > 0, 1).otherwise(0) - F.when(F.col("had") > 0, 1).otherwise(0)).alias("flip")).filter("flip <> 0")
    return stash(rest.unionByName(met.filter("n > 0").select(*keys, "n")), "counts"), stash(flips, "flips")


def _moved(keys: DataFrame, before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Those of the keys that are in one of two tables only."""
    k = keys.select(on).distinct()
    was, now = k.join(before.select(on), on, "left_semi"), k.join(after.select(on), on, "left_semi")
    return stash(was.join(now, on, "left_anti").unionByName(now.join(was, on, "left_anti")), "moved")


def _mentions(facts: DataFrame, skip: str) -> DataFrame:
    """property, side, inst, change: the mentions in facts, which are (s, p, o) and hold the column ``change``."""
    k = facts.filter(F.col("p") != skip)
    subjects = k.select(F.col("p").alias("property"), F.lit("subject").alias("side"), F.col("s").alias("inst"), "change")
    return subjects.unionByName(k.filter(~is_literal(F.col("o"))).select(F.col("p").alias("property"), F.lit("object").alias("side"), F.col("o").alias("inst"), "change"))


def _verdicts(facts: DataFrame, types: DataFrame, rules: DataFrame, hits: DataFrame) -> DataFrame:
    """s, p, o, before, verdict of some facts (s, p, o, before), from the types and hits of their own instances alone."""
    insts = stash(facts.select(F.col("s").alias("inst")).union(facts.select("o")).distinct(), "some-insts")
    return verdicts_by(facts, types.join(insts, "inst", "left_semi"), rules, hits.join(insts, "inst", "left_semi").select(SIDE).distinct(), ["before"])


def _touched(facts: DataFrame, fits: DataFrame, typed: DataFrame, ruled: DataFrame) -> DataFrame:
    """facts with a boolean, touched: they are new, or rest on something that flipped."""
    few = ruled.select(F.col("property").alias("p"), F.lit(True).alias("ruled")).distinct()
    f = facts.join(few, "p", "left").withColumn("touched", F.col("before").isNull() | F.col("ruled").isNotNull())
    for side, column in (("subject", "s"), ("object", "o")):
        flips = fits.filter(F.col("side") == side).select("inst", "property").unionByName(typed.select("inst", F.lit(None).cast("string").alias("property")))
        flips = flips.groupBy(F.col("inst").alias(column)).agg(F.collect_set("property").alias("moved"), F.bool_or(F.col("property").isNull()).alias("retyped"))
        hit = F.col("retyped") | F.array_contains("moved", F.col("p"))
        f = f.join(flips, column, "left").withColumn("touched", F.col("touched") | F.coalesce(hit, F.lit(False))).drop("moved", "retyped")
    return f.select(*FACTS, "before", "touched")


def apply_changes(state: Checked, full: DataFrame, types: DataFrame, rules: DataFrame, facts: DataFrame, skip: str = UNCHECKED_PROPERTY) -> Checked:
    """The state after changes of types (inst, cls, change), rules (property, side, type, change) and facts (s, p, o, change).

    change is above zero for a row that is inserted, below for one that is deleted; deletions of what isn't there and
    insertions of what is don't count. Tables of the state are rewritten in one join with the changes; joins with the closure
    are made for what changed alone, and so are verdicts unless much has flipped.
    """
    full = full.select("node", "anc")
    dt, dr = _effective(state.types, types, TYPES), _effective(state.rules, rules, RULES)
    now_types, now_rules = _after(state.types, dt, TYPES), _after(state.rules, dr, RULES)

    # Hits: changed types under the old rules, all types under changed rules.
    above = dt.join(full, F.col("cls") == F.col("node")).join(state.rules.withColumnRenamed("type", "anc"), "anc")
    below = full.join(dr.withColumnRenamed("type", "anc"), "anc").select("node", "property", "side", F.col("anc").alias("type"), "change")
    d_hits = above.select("property", "side", F.col("anc").alias("type"), "inst", "change").unionByName(now_types.join(below, F.col("cls") == F.col("node")).select("property", "side", "type", "inst", "change"))
    hits, hit_flips = _added(state.hits, d_hits, [*RULES, "inst"])

    # Facts that rest on something that came or went: a fit, having a type at all, a side of a property having rules.
    fits = _moved(hit_flips, state.hits, hits, SIDE)
    typed = _moved(dt, state.types, now_types, ["inst"])
    ruled = _moved(dr, state.rules, now_rules, ["property", "side"])
    met = state.facts.withColumnRenamed("verdict", "before").join(_wish(facts, FACTS), FACTS, "full").filter("before is not null or change > 0")
    met = stash(met.select(*FACTS, "before", F.coalesce(F.col("change") > 0, F.lit(True)).alias("here")), "met-facts")
    here = met.filter("here").select(*FACTS, "before")
    flipped = fits.select("inst").union(typed.select("inst")).distinct().count()
    if flipped * FLIPPED_PARTS > now_types.select("inst").distinct().count():
        given = verdicts_by(here, now_types, now_rules, hits.select(SIDE).distinct(), ["before"]).withColumnRenamed("verdict", "after")
    else:
        marked = stash(_touched(here, fits, typed, ruled), "marked")
        again = _verdicts(marked.filter("touched").drop("touched"), now_types, now_rules, hits)
        given = again.withColumnRenamed("verdict", "after").unionByName(marked.filter("not touched").select(*FACTS, "before", F.col("before").alias("after")))
    # One table of all facts, before and after; what is there and what changed are parts of it.
    both = stash(given.unionByName(met.filter("not here").select(*FACTS, "before", F.lit(None).cast("string").alias("after"))), "verdicts")
    now_facts = both.filter("after is not null").select(*FACTS, F.col("after").alias("verdict"))
    changed = both.filter("not (before <=> after)").select(*FACTS, "before", "after")
    if state.mentions is None:
        return Checked(now_types, now_rules, now_facts, hits, None, None, changed)

    # Uses: changed mentions under the hits that are, old mentions under the hits that flipped.
    ok = F.when(F.coalesce(F.col("after") == "ok", F.lit(False)), 1).otherwise(0) - F.when(F.coalesce(F.col("before") == "ok", F.lit(False)), 1).otherwise(0)
    d_mentions = stash(_mentions(changed.select(*FACTS, ok.alias("change")).filter("change <> 0"), skip).groupBy(*SIDE).agg(F.sum("change").cast("long").alias("change")).filter("change <> 0"), "d-mentions")
    d_used = d_mentions.join(hits, SIDE).select(*RULES, "change").unionByName(state.mentions.join(hit_flips, SIDE).select(*RULES, (F.col("n") * F.col("flip")).alias("change")))
    mentions, _ = _added(state.mentions, d_mentions, SIDE)
    d_used = d_used.groupBy(*RULES).agg(F.sum("change").cast("long").alias("change"))
    usage = now_rules.join(state.usage, RULES, "left").join(d_used, RULES, "left").select(*RULES, (F.coalesce("used", F.lit(0)) + F.coalesce("change", F.lit(0))).cast("long").alias("used"))
    return Checked(now_types, now_rules, now_facts, hits, mentions, stash(usage, "usage"), changed)


def checked(full: DataFrame, types: DataFrame, rules: DataFrame, facts: DataFrame, skip: str = UNCHECKED_PROPERTY, uses: bool = True) -> Checked:
    """The state of given types, rules and facts over a closure (node, anc), with uses or without."""
    t, r, f = (stash(x.select(keys).dropna().distinct(), "checked") for x, keys in ((types, TYPES), (rules, RULES), (facts, FACTS)))
    above = full.select("node", "anc").join(r.withColumnRenamed("type", "anc"), "anc")
    hits = t.join(above, F.col("cls") == F.col("node")).groupBy("property", "side", F.col("anc").alias("type"), "inst").agg(F.count("*").alias("n"))
    hits = stash(hits, "hits")
    verdicts = stash(verdicts_by(f, t, r, hits.select(SIDE).distinct()), "verdicts")
    changed = verdicts.select(*FACTS, F.lit(None).cast("string").alias("before"), F.col("verdict").alias("after"))
    if not uses:
        return Checked(t, r, verdicts, hits, None, None, changed)
    mentions = stash(_mentions(verdicts.filter("verdict = 'ok'").withColumn("change", F.lit(1)), skip).groupBy(*SIDE).agg(F.count("*").alias("n")), "mentions")
    used = mentions.join(hits.select(*RULES, "inst"), SIDE).groupBy(*RULES).agg(F.sum("n").alias("used"))
    return Checked(t, r, verdicts, hits, mentions, stash(r.join(used, RULES, "left").fillna(0, ["used"]), "usage"), changed)
