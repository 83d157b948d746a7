"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing, each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoforge.llm import line_dedup, mixing, packing, quality, simhash
from taxoforge.llm.common import release_shuffles, stash, table
from taxoforge.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents share; n_chars follows. Repeated rows lose them alike."""
    kept = line_dedup.replace_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row stays: of the document that gives it its name, or of rows without an id where
    there is no other, the text of least fingerprint and hash. Rows that repeat an id with unlike texts are documents of
    their own, as they are when groups are made; of equal rows one stays, the least by its other columns."""
    def row_keys(doc_id: str, th: str) -> list[Column]:
        """Plain columns for a null-safe key, so that joining and grouping by it share one shuffle."""
        return [F.coalesce(doc_id, F.lit(0)).cast("long").alias("d0"), F.col(doc_id).isNull().alias("dn"), F.col(th).alias("th")]

    groups = simhash.near_groups(docs.select(*COLUMNS)).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.groupBy("root").agg(F.min(F.struct("fp", "th")).alias("low"), F.first("component_id", ignorenulls=True).alias("kept_id"))
    kept = stash(kept.select("kept_id", F.col("low.th").alias("kept_th")).select(*row_keys("kept_id", "kept_th")).distinct(), "near-kept")
    release_shuffles(spark)
    own = docs.select(*COLUMNS, F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("string")).alias("own_th"))
    named = own.select(*COLUMNS, *row_keys("doc_id", "own_th")).join(kept, ["d0", "dn", "th"], "left_semi")
    one = named.groupBy("d0", "dn", "th").agg(F.first("doc_id").alias("doc_id"), F.first("text", ignorenulls=True).alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the schedule takes them."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The network's scores have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None
