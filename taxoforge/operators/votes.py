"""Votes of several judges on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxoforge.functions.decisions import SUBSUME, THRESHOLD, conclusion


def conclude(predictions: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """model, child, parent, verdict, conf for predictions (model, child, parent, plabel, clabel, answer,
    answer_inverse, confidence, confidence_inverse)."""
    verdict, conf = conclusion(*(F.col(c) for c in ("plabel", "clabel", "answer", "answer_inverse", "confidence", "confidence_inverse")), t)
    return predictions.select("model", "child", "parent", verdict.alias("verdict"), conf.alias("conf"))


def first_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row at the first position of each key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).filter("nth = 1").drop("nth")


def last_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row at the last position of each key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(position)))).filter("nth = 1").drop("nth")


def majority(verdicts: DataFrame) -> DataFrame:
    """child, parent, verdict, conf: the verdict that most models give, with the least confidence among them; without
    one such verdict, subsumption with confidence 1."""
    tally = verdicts.groupBy("child", "parent", "verdict").agg(F.count("*").alias("n"), F.min("conf").alias("conf"))
    best = tally.groupBy("child", "parent").agg(F.max("n").alias("top"), F.max_by(F.struct("verdict", "conf"), F.struct("n", "verdict")).alias("win"), F.collect_list("n").alias("ns"))
    clear = F.size(F.filter("ns", lambda x: x == F.col("top"))) == 1
    return best.select("child", "parent", F.when(clear, F.col("win.verdict")).otherwise(SUBSUME).alias("verdict"), F.when(clear, F.col("win.conf")).otherwise(F.lit(1.0)).alias("conf"))


def rewire_vote(predictions: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """child, parent, ok, conf: accepted iff subsumption alone has most votes, with the least confidence among them.

    A model votes by its two answers, true or false each, if both confidences reach ``t``; equal labels count for
    nothing here, and other answers are no vote. Without votes a link is refused.
    """
    a, b = F.lower("answer"), F.lower("answer_inverse")
    conf = F.least("confidence", "confidence_inverse")
    sure = (conf >= t) & a.isin("true", "false") & b.isin("true", "false")
    votes = predictions.select("child", "parent", F.when(sure, F.concat_ws("/", a, b)).alias("vote"), conf.alias("conf"))
    kinds = ("true/false", "false/true", "true/true", "false/false")
    n = [F.count_if(F.col("vote") == k).alias(f"n{i}") for i, k in enumerate(kinds)]
    tally = votes.groupBy("child", "parent").agg(*n, F.min(F.when(F.col("vote") == kinds[0], F.col("conf"))).alias("low"))
    ok = F.col("n0") > F.greatest("n1", "n2", "n3")
    return tally.select("child", "parent", ok.alias("ok"), F.when(ok, F.col("low")).otherwise(F.lit(0.0)).alias("conf"))


def missing_predictions(edges: DataFrame, predictions: DataFrame) -> DataFrame:
    """model, child, parent: edges that one of the models has no prediction for."""
    models = predictions.select("model").distinct()
    asked = edges.select("child", "parent").distinct().join(F.broadcast(models))
    return asked.join(predictions.select("model", "child", "parent"), ["model", "child", "parent"], "left_anti").select("model", "child", "parent")


def require_predictions(edges: DataFrame, predictions: DataFrame) -> None:
    """ValueError unless every model has a prediction for every edge."""
    bad = missing_predictions(edges, predictions).orderBy("model", "child", "parent").first()
    if bad:
        raise ValueError(f"{bad['model']} has no prediction for {bad['child']} under {bad['parent']} (and perhaps others)")
