"""Queries on type checks that are kept up: under changes, and on streams where facts may come before types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoforge.operators import checks
from taxoforge.operators.closure import closure
from taxoforge.plans.catalog import query, sql
from taxoforge.plans.projection import kg
from taxoforge.scratch import scratch_folder, stash
from taxoforge.streaming.waiting import EVENT, start_waiting

# ---- under changes -----------------------------------------------------------------------------------------------


def check_sql(at: str, types: str, rules: str, facts: str) -> str:
    """w{at}: s, p, o, verdict; hit{at}: property, side, type, inst."""
    return f"""hit{at} AS (SELECT DISTINCT k.property, k.side, k.type, t.inst FROM {types} t JOIN clo ON t.cls = clo.node JOIN {rules} k ON k.type = clo.anc),
fit{at} AS (SELECT DISTINCT property, side, inst FROM hit{at}), typed{at} AS (SELECT DISTINCT inst FROM {types}), has{at} AS (SELECT DISTINCT property, side FROM {rules}),
w{at} AS (SELECT f.s, f.p, f.o, CASE WHEN hs.side IS NOT NULL AND ts.inst IS NULL THEN 'no_types_for_subject' WHEN hs.side IS NOT NULL AND fs.inst IS NULL THEN 'domain_constraint_not_satisfied'
  WHEN ho.side IS NOT NULL AND tob.inst IS NULL THEN 'no_types_for_object' WHEN ho.side IS NOT NULL AND fo.inst IS NULL THEN 'range_constraint_not_satisfied' ELSE 'ok' END AS verdict
  FROM {facts} f LEFT JOIN has{at} hs ON hs.property = f.p AND hs.side = 'subject' LEFT JOIN has{at} ho ON ho.property = f.p AND ho.side = 'object'
  LEFT JOIN typed{at} ts ON ts.inst = f.s LEFT JOIN typed{at} tob ON tob.inst = f.o
  LEFT JOIN fit{at} fs ON fs.property = f.p AND fs.side = 'subject' AND fs.inst = f.s LEFT JOIN fit{at} fo ON fo.property = f.p AND fo.side = 'object' AND fo.inst = f.o)"""


BEFORE, AFTER = check_sql("0", "kg_types", "kg_constraints", "kg_facts"), check_sql("1", "kg_types_after", "kg_constraints_after", "kg_facts_after")
AFTER_TABLES = ("kg_types_after", "kg_constraints_after", "kg_facts_after")


def _changed(spark: SparkSession, d: str, uses: bool = False) -> checks.Checked:
    full, facts = stash(closure(kg(spark, d, "kg_edges")), "closure"), kg(spark, d, "kg_facts")
    state = checks.checked(full, kg(spark, d, "kg_types"), kg(spark, d, "kg_constraints"), facts, uses=uses)
    return checks.apply_changes(state, full, kg(spark, d, "kg_type_changes"), kg(spark, d, "kg_constraint_changes"), kg(spark, d, "kg_fact_changes", {"kg_facts": facts}))


@query("kg_checks_kept_up", sql(*AFTER_TABLES, more=AFTER, body="SELECT s, p, o, verdict FROM w1"))
def q_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts after changes of types, constraints and facts, from those before."""
    return _changed(spark, d).facts


@query("kg_checks_changed", sql("kg_types", "kg_constraints", "kg_facts", *AFTER_TABLES, more=BEFORE + ", " + AFTER,
    body="SELECT coalesce(a.s, b.s) AS s, coalesce(a.p, b.p) AS p, coalesce(a.o, b.o) AS o, a.verdict AS before, b.verdict AS after FROM w0 a FULL JOIN w1 b ON a.s = b.s AND a.p = b.p AND a.o = b.o WHERE a.verdict IS DISTINCT FROM b.verdict"))
def q_changed(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts that came, went or became others."""
    return _changed(spark, d).changed


@query("kg_usage_kept_up", sql(*AFTER_TABLES, more=AFTER + """, said AS (SELECT p AS property, 'subject' AS side, s AS inst FROM w1 WHERE verdict = 'ok' UNION ALL SELECT p, 'object', o FROM w1 WHERE verdict = 'ok')""",
    body="SELECT k.property AS property, k.side AS side, k.type AS type, cast(count(m.inst) AS bigint) AS used FROM kg_constraints_after k LEFT JOIN hit1 h ON h.property = k.property AND h.side = k.side AND h.type = k.type LEFT JOIN said m ON m.property = h.property AND m.side = h.side AND m.inst = h.inst GROUP BY k.property, k.side, k.type"))
def q_usage_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """How often kept facts use each constraint, after the changes."""
    return _changed(spark, d, uses=True).usage


# ---- facts that come before their types --------------------------------------------------------------------------


def write_events(types: DataFrame, facts: DataFrame, path: str, files: int = 3) -> None:
    """Types (inst, cls) and facts (s, p, o) as events in an order that nothing follows, within 50 minutes; then two signs
    of life of the clock, much later, so that all that waits comes to its end."""
    no = F.lit(None).cast("string")
    said = types.select(F.lit("type").alias("kind"), "inst", "cls", no.alias("s"), no.alias("p"), no.alias("o"))
    rows = said.unionByName(facts.select(F.lit("fact").alias("kind"), no.alias("inst"), no.alias("cls"), "s", "p", "o"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64(*rows.columns), F.lit(3000)))
    rows.withColumn("ts", at).repartition(files, F.xxhash64(F.lit("file"), *rows.columns)).write.mode("append").parquet(path)
    for late in (100_000, 200_000):
        tick = types.sparkSession.range(1, numPartitions=1).select(F.lit("type").alias("kind"), F.lit("clock").alias("inst"), F.lit("tick").alias("cls"), no.alias("s"), no.alias("p"), no.alias("o"), F.timestamp_seconds(F.lit(1_700_000_000 + late)).alias("ts"))
        tick.write.mode("append").parquet(path)


@query("kg_stream_waiting", sql("kg_facts", "kg_untyped", "kg_constraints", more=check_sql("0", "kg_untyped", "kg_constraints", "kg_facts"), body="SELECT s, p, o, verdict FROM w0"))
def q_waiting(spark: SparkSession, d: str) -> DataFrame:
    """The type check on a stream of types and facts in mixed order, where facts wait for their types."""
    root = scratch_folder(spark, "waiting")
    write_events(kg(spark, d, "kg_untyped"), kg(spark, d, "kg_facts"), f"{root}/in", files=2)
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    full = stash(closure(kg(spark, d, "kg_edges")), "closure")
    start_waiting(events, full, kg(spark, d, "kg_constraints"), f"{root}/out", f"{root}/log", lateness="2 hours").awaitTermination()
    return spark.read.schema("s string, p string, o string, verdict string").parquet(f"{root}/out")
