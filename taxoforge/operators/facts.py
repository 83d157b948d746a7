"""The facts stage: which triples become facts, what types instances get, which facts their constraints allow.

Verdicts are one CASE over flags that semi-joins give, in the order in which the reasons apply, so a triple has one
verdict. Type checks never join facts to a closure: who satisfies which constraint is worked out once per property, side
and instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoforge.functions.terms import in_english, is_literal
from taxoforge.operators.closure import nearest_kept, nodes_of
from taxoforge.operators.graph import resolve_mapping
from taxoforge.scratch import HEAVY_PARTS, stash

# Predicates and the reasons for which a triple is no fact.
TYPE, SUBCLASS = "wdt:P31", "wdt:P279"
REDUNDANT = ["skos:prefLabel", "schema:name"]
UNCHECKED_PROPERTY = "wdt:P106"


def keep_predicates(triples: DataFrame, predicates: list[str]) -> DataFrame:
    return triples.filter(F.col("p").isin(predicates))


#: Keys that the search for hot ones keeps count of; its counts are off by a few parts in this many of all rows.
TRACKED = 20_000


def hot_keys(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """Values of each column that hold over 1/HEAVY_PARTS of all rows, fewer than twice HEAVY_PARTS, from one pass with a
    sketch of frequent items. They decide how rows travel, never what comes out. Streams, which can't be passed over
    beforehand, have none."""
    if df.isStreaming:
        return {c: [] for c in columns}
    top = df.agg(F.count("*").alias("n"), *(F.expr(f"approx_top_k({c}, {HEAVY_PARTS}, {TRACKED})").alias(c) for c in columns)).first()
    bar = max(1, top["n"] // HEAVY_PARTS)
    return {c: [x["item"] for x in top[c] or () if x["count"] > bar and x["item"] is not None] for c in columns}


def looked_up(df: DataFrame, column: str, members: DataFrame, hot: list) -> DataFrame:
    """df left joined with members (member, unique, and more columns) on a column. Rows of hot values get theirs from the few
    members sent out to all, and are spread over the shuffle of the others by their own hash."""
    names = [c for c in members.columns if c != "member"]
    if not hot:
        return df.join(members, F.col(column) == F.col("member"), "left").drop("member")
    members = stash(members, "members")
    few = df.sparkSession.createDataFrame([(x,) for x in hot], "hot string")
    few = stash(few.join(members, F.col("hot") == F.col("member"), "left").select("hot", *(F.col(c).alias(f"hot_{c}") for c in names)), "hot-members")
    near = df.join(F.broadcast(few), F.col(column) == F.col("hot"), "left")
    spread = F.concat(F.lit("\x00"), F.xxhash64(*df.columns).cast("string"))
    near = near.withColumn("join_key", F.when(F.col("hot").isNotNull(), spread).otherwise(F.col(column)))
    out = near.join(members, F.col("join_key") == F.col("member"), "left")
    return out.select(*(df[c] for c in df.columns), *(F.when(F.col("hot").isNotNull(), F.col(f"hot_{c}")).otherwise(F.col(c)).alias(c) for c in names))


#: Predicates sent out to all tasks at most, a name and a few booleans each.
SENT_ROWS = 10_000


def by_predicate(df: DataFrame, members: DataFrame, hot: list) -> DataFrame:
    """looked_up on p. Predicates are few as a rule, and each is hot: counted and sent out, so the facts don't travel."""
    members = stash(members, "predicates")
    if members.count() > SENT_ROWS:
        return looked_up(df, "p", members, hot)
    return df.join(F.broadcast(members), F.col("p") == F.col("member"), "left").drop("member")


def flagged(df: DataFrame, column: str, sets: dict[str, DataFrame], hot: list) -> DataFrame:
    """df with a boolean for each set: is the column's value among its members (one column)? One join for all sets."""
    every = None
    for name, members in sets.items():
        one = members.toDF("member").select("member", *(F.lit(n == name).alias(n) for n in sets))
        every = one if every is None else every.unionByName(one)
    known = every.groupBy("member").agg(*(F.bool_or(n).alias(n) for n in sets))
    found = by_predicate(df, known, hot) if column == "p" else looked_up(df, column, known, hot)
    return found.fillna(False, list(sets))


def type_verdicts(triples: DataFrame, labelled: DataFrame, classes: DataFrame) -> DataFrame:
    """s, p, o, verdict of type statements; null: kept. Items with neither type nor label get one row of their own."""
    typed = triples.filter(F.col("p") == TYPE)
    hot = hot_keys(typed, ["s", "o"])
    t = flagged(flagged(typed, "s", {"named": labelled}, hot["s"]), "o", {"known": classes}, hot["o"])
    verdict = F.when(~F.col("named"), "instance_no_label").when(~F.col("known"), F.concat(F.lit("type_"), F.col("o"), F.lit("_not_a_valid_class")))
    rows = t.select("s", "p", "o", verdict.alias("verdict"))
    bare = triples.groupBy("s").agg(F.bool_or(F.col("p") == TYPE).alias("typed")).filter("s is null or not coalesce(typed, false)").join(labelled.distinct().toDF("s"), "s", "left_anti")
    return rows.unionByName(bare.select("s", F.lit(TYPE).alias("p"), F.lit("None_Type").alias("o"), F.lit("instance_no_label").alias("verdict")))


def fact_verdicts(triples: DataFrame, labelled: DataFrame, unlabelled: DataFrame, scholarly: DataFrame, identifiers: DataFrame) -> DataFrame:
    """s, p, o, verdict of all triples; kept ones have the verdict "kept", those that go without a trace "silent:..."."""
    hot = hot_keys(triples, ["s", "p", "o"])
    t = flagged(triples, "s", {"paper": scholarly, "named": labelled, "bare_s": unlabelled}, hot["s"])
    t = flagged(t, "o", {"bare_o": unlabelled}, hot["o"])
    t = flagged(t, "p", {"external": identifiers}, hot["p"])
    return t.select("s", "p", "o", _fact_verdict().alias("verdict"))


def _fact_verdict() -> Column:
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    return (
        F.when(p == "rdf:type", "silent:type")
        .when(F.col("paper"), "silent:scholarly")
        .when(~F.col("named") | F.col("bare_s") | F.col("bare_o"), "non_labeled_subject_or_object")
        .when(p.isin(TYPE, SUBCLASS), "silent:class")
        .when(p.isin(REDUNDANT), "redundant_facts")
        .when(p.startswith("wdtn:"), "meta_facts")
        .when(s == o, "rare_facts_s_o_equal")
        .when(~in_english(o), "silent:language")
        .when(F.col("external"), "silent:identifier")
        .otherwise("kept")
    )


def redundant_types(types: DataFrame, strict: DataFrame) -> DataFrame:
    """inst, cls: types that lie above another type of the same instance.

    Types come together by instance, and only instances with several go on: their pairs of classes, each once, meet the
    closure, so neither single types nor popular classes are followed upward.
    """
    many = types.select("inst", "cls").distinct().groupBy("inst").agg(F.collect_set("cls").alias("own")).filter("size(own) > 1")
    pairs = many.select("inst", F.explode("own").alias("node"), "own").select("inst", "node", F.explode("own").alias("cls")).filter("node <> cls")
    kinds = pairs.select("node", "cls").distinct().join(strict.select("node", F.col("anc").alias("cls")), ["node", "cls"], "left_semi")
    return pairs.join(kinds, ["node", "cls"], "left_semi").select("inst", "cls").distinct()


def retype(types: DataFrame, before: DataFrame, after: DataFrame, mapping: DataFrame, root: str, strict_before: DataFrame, strict_after: DataFrame) -> DataFrame:
    """inst, cls, verdict: instances on the clean classes; kept types have verdict null.

    Merged classes are followed; types not in the graph before filtering go; of several types the more general go; what
    is not in the final graph climbs to its nearest final ancestors but the root; the more general go once more.
    """
    in_before = nodes_of(before).select("node", F.lit(True).alias("early"), F.lit(False).alias("final"))
    in_after = nodes_of(after).select("node", F.lit(False).alias("early"), F.lit(True).alias("final"))
    places = in_before.unionByName(in_after).groupBy("node").agg(F.bool_or("early").alias("early"), F.bool_or("final").alias("final"))
    m = resolve_mapping(mapping)
    t = types.join(m, F.col("cls") == F.col("src"), "left").select("inst", F.coalesce("dst", "cls").alias("cls")).distinct()
    t = stash(t.join(places, F.col("cls") == F.col("node"), "left").select("inst", "cls", "early", "final").fillna(False, ["early", "final"]), "placed")
    lost = t.filter("not early").select("inst", "cls", F.concat(F.lit("type_"), "cls", F.lit("_being_deleted_during_taxonomy_cleaning")).alias("verdict"))
    short = stash(redundant_types(t.filter("early"), strict_before), "shortcuts")
    kept = t.filter("early").join(short, ["inst", "cls"], "left_anti")
    up = nearest_kept(before, nodes_of(after).filter(F.col("node") != root)).withColumn("least", F.min("dist").over(Window.partitionBy("node"))).filter("dist = least")
    climbed = kept.filter("not final").join(up.select(F.col("node").alias("cls"), "anc"), "cls", "left").select("inst", "cls", "anc")
    moved = stash(kept.filter("final").select("inst", "cls", F.col("cls").alias("anc")).unionByName(climbed), "climbed")
    gone = moved.filter("anc is null").select("inst", "cls", F.concat(F.lit("type_"), "cls", F.lit("_lost_after_wikipedia_filtering")).alias("verdict"))
    got = stash(moved.filter("anc is not null").select("inst", F.col("anc").alias("cls")).distinct(), "climbed-to")
    again = stash(redundant_types(got, strict_after), "shortcuts")
    out = got.join(again, ["inst", "cls"], "left_anti").withColumn("verdict", F.lit(None).cast("string"))
    shortcuts = short.unionByName(again).distinct().withColumn("verdict", F.lit("is_a_shortcut"))
    return out.unionByName(lost).unionByName(gone).unionByName(shortcuts)


def satisfied(types: DataFrame, full: DataFrame, constraints: DataFrame) -> DataFrame:
    """property, side, inst: instances with a type at or below a type that the property allows on that side."""
    above = full.join(constraints.select("property", "side", F.col("type").alias("anc")), "anc").select("node", "property", "side").distinct()
    return types.join(above, F.col("cls") == F.col("node")).select("property", "side", "inst").distinct()


def _checked(facts: DataFrame, types: DataFrame, constraints: DataFrame, ok: DataFrame) -> DataFrame:
    has = constraints.groupBy(F.col("property").alias("p")).agg(F.bool_or(F.col("side") == "subject").alias("has_domain"), F.bool_or(F.col("side") == "object").alias("has_range"))
    hot = hot_keys(facts, ["s", "p", "o"])
    f = by_predicate(facts, has.withColumnRenamed("p", "member"), hot["p"]).fillna(False, ["has_domain", "has_range"])
    for side, column in (("subject", "s"), ("object", "o")):
        # What an instance fits on a side is a list of properties, so one join says whether it is typed and whether it fits.
        fits = ok.filter(F.col("side") == side).groupBy("inst").agg(F.collect_set("property").alias("fit"))
        known = types.select("inst").distinct().join(fits, "inst", "left").select(F.col("inst").alias("member"), F.lit(True).alias(f"typed_{side}"), "fit")
        f = looked_up(f, column, known, hot[column]).fillna(False, [f"typed_{side}"])
        f = f.withColumn(f"fits_{side}", F.coalesce(F.array_contains("fit", F.col("p")), F.lit(False))).drop("fit")
    return f


def _verdict() -> Column:
    def of(side: str, name: str, has: str) -> Column:
        return F.when(F.col(has) & ~F.col(f"typed_{side}"), f"no_types_for_{side}").when(F.col(has) & ~F.col(f"fits_{side}"), f"{name}_constraint_not_satisfied")

    return F.coalesce(of("subject", "domain", "has_domain"), F.when(~is_literal(F.col("o")), of("object", "range", "has_range")), F.lit("ok"))


def judged_facts(triples: DataFrame, labelled: DataFrame, unlabelled: DataFrame, scholarly: DataFrame, identifiers: DataFrame, types: DataFrame, constraints: DataFrame, ok: DataFrame) -> DataFrame:
    """s, p, o, verdict, checked: the verdicts of ``fact_verdicts`` and, for facts that it keeps, of ``check_facts``; ok as
    for ``verdicts_by``. Subjects, objects and predicates are looked up once for both, so triples travel twice, not four times."""
    hot = hot_keys(triples, ["s", "p", "o"])
    f = triples.select("s", "p", "o")
    for side, column, sets in (("subject", "s", {"paper": scholarly, "named": labelled, "bare_s": unlabelled}), ("object", "o", {"bare_o": unlabelled})):
        flags = sets | {f"typed_{side}": types.select("inst")}
        rows = ok.filter(F.col("side") == side).select(F.col("inst").alias("member"), F.lit("").alias("flag"), F.col("property").alias("fit"))
        for name, members in flags.items():
            rows = rows.unionByName(members.toDF("member").select("member", F.lit(name).alias("flag"), F.lit(None).cast("string").alias("fit")))
        known = rows.groupBy("member").agg(*(F.bool_or(F.col("flag") == name).alias(name) for name in flags), F.collect_set("fit").alias("fit"))
        f = looked_up(f, column, known, hot[column]).fillna(False, list(flags))
        f = f.withColumn(f"fits_{side}", F.coalesce(F.array_contains("fit", F.col("p")), F.lit(False))).drop("fit")
    rules = constraints.select(F.col("property").alias("member"), (F.col("side") == "subject").alias("has_domain"), (F.col("side") == "object").alias("has_range"), F.lit(False).alias("external"))
    rules = rules.unionByName(identifiers.toDF("member").select("member", F.lit(False).alias("has_domain"), F.lit(False).alias("has_range"), F.lit(True).alias("external")))
    rules = rules.groupBy("member").agg(*(F.bool_or(c).alias(c) for c in ("has_domain", "has_range", "external")))
    f = by_predicate(f, rules, hot["p"]).fillna(False, ["has_domain", "has_range", "external"])
    f = f.withColumn("verdict", _fact_verdict())
    return f.select("s", "p", "o", "verdict", F.when(F.col("verdict") == "kept", _verdict()).alias("checked"))


def check_facts(facts: DataFrame, types: DataFrame, full: DataFrame, constraints: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """s, p, o, verdict, and ``extra`` columns of the facts: "ok" or the first constraint that a fact fails; literal
    objects have no range to fail.

    facts: s, p, o; types: inst, cls; constraints: property, side (subject or object), type.
    """
    return verdicts_by(facts, types, constraints, satisfied(types, full, constraints), extra)


def verdicts_by(facts: DataFrame, types: DataFrame, constraints: DataFrame, ok: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """check_facts with what it works out first already known: ok (property, side, inst), see ``satisfied``."""
    return _checked(facts, types, constraints, ok).select("s", "p", "o", *(extra or []), _verdict().alias("verdict"))


def double_failures(facts: DataFrame, types: DataFrame, full: DataFrame, constraints: DataFrame) -> DataFrame:
    """s, p, o, reason: facts that fail on both sides at once, rows of statistics beside the verdicts."""
    f = _checked(facts, types, constraints, satisfied(types, full, constraints)).filter("has_domain and has_range")
    none = ~F.col("typed_subject") & ~F.col("typed_object")
    both = F.col("typed_subject") & F.col("typed_object") & ~F.col("fits_subject") & ~F.col("fits_object")
    reason = F.when(none, "no_types_for_domain_and_range").when(both, "both_domain_and_range_constraint_not_satisfied")
    return f.select("s", "p", "o", reason.alias("reason")).filter("reason is not null")


def constraint_usage(kept: DataFrame, types: DataFrame, full: DataFrame, constraints: DataFrame, skip: str = UNCHECKED_PROPERTY) -> DataFrame:
    """property, side, type, used: facts whose instance on that side has a type at or below the allowed type."""
    above = full.join(constraints.select("property", "side", F.col("type").alias("anc")), "anc").select("node", "property", "side", F.col("anc").alias("type"))
    hits = types.join(above, F.col("cls") == F.col("node")).select("property", "side", "type", "inst").distinct()
    k = kept.filter(F.col("p") != skip).distinct()
    mentions = k.select(F.col("p").alias("property"), F.lit("subject").alias("side"), F.col("s").alias("inst")).unionByName(k.filter(~is_literal(F.col("o"))).select(F.col("p").alias("property"), F.lit("object").alias("side"), F.col("o").alias("inst")))
    n = mentions.groupBy("property", "side", "inst").agg(F.count("*").alias("facts"))
    used = n.join(hits, ["property", "side", "inst"]).groupBy("property", "side", "type").agg(F.sum("facts").alias("used"))
    return constraints.select("property", "side", "type").distinct().join(used, ["property", "side", "type"], "left").fillna(0, ["used"])


def unused_types(usage: DataFrame, kept: DataFrame, skip: str = UNCHECKED_PROPERTY) -> DataFrame:
    """property, side, type: allowed types without use, of properties that kept facts have."""
    live = kept.select(F.col("p").alias("property")).distinct().filter(F.col("property") != skip)
    return usage.filter("used = 0").join(live, "property", "left_semi").select("property", "side", "type")


def prune_constraints(constraints: DataFrame, unused: DataFrame) -> DataFrame:
    return constraints.join(unused, ["property", "side", "type"], "left_anti")
