"""A session with the settings that the engine's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "taxoforge", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """Adaptive execution with skew joins and coalescing, Arrow, UTC; on a cluster the master comes from spark-submit.

    ``spark.checkpoint.dir`` must name a folder that all executors share; without one, as in tests, scratch tables go
    to a folder of the local machine.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in more.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
