"""Checking facts as they arrive: the type check of the facts stage on a stream, against static types and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taxoforge.operators.facts import check_facts


def stream_verdicts(facts: DataFrame, types: DataFrame, full: DataFrame, constraints: DataFrame) -> DataFrame:
    """s, p, o, verdict of a stream of facts (s, p, o): stream-static joins alone, so no state is kept."""
    return check_facts(facts, types, full, constraints)


def start_two_way(facts: DataFrame, types: DataFrame, full: DataFrame, constraints: DataFrame, kept_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Run the check, kept facts to one folder and rejected ones to another, each micro-batch once: a batch that is
    repeated after a failure overwrites its own part."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.filter("verdict = 'ok'").select("s", "p", "o").write.mode("overwrite").parquet(f"{kept_path}/epoch={epoch}")
        batch.filter("verdict <> 'ok'").write.mode("overwrite").parquet(f"{rejected_path}/epoch={epoch}")
        batch.unpersist()

    return stream_verdicts(facts, types, full, constraints).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rejections(facts: DataFrame, types: DataFrame, full: DataFrame, constraints: DataFrame, time: str = "ts", lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """window, verdict, n of a stream with event time: late facts are counted up to ``lateness``."""
    stamped = facts.withWatermark(time, lateness)
    ok = check_facts(stamped.select("s", "p", "o", time), types, full, constraints, extra=[time])
    return ok.groupBy(F.window(time, width), "verdict").agg(F.count("*").alias("n"))
