"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoforge.scratch import HEAVY_PARTS, drop_stash, heavy_join, release_shuffles, scratch_root, stash

__all__ = ["HEAVY_PARTS", "SPACE", "WORD_PATTERN", "as_text", "drop_stash", "heavy_join", "release_shuffles", "scratch_root", "small_batches", "stash", "table", "trim_worker"]

#: ASCII white space, the only separators that words and line keys know: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session: batches of whole texts live in the executor and its workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def as_text(c: Column | str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def trim_worker() -> None:
    """At the end of a task: hand memory that a reused Python worker has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
