"""Scratch tables in the shared folder, and joins that no hot key can stall."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A session without one gets a folder of its own: in the warehouse, which is
    shared too, or on a single machine in its temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        alone = master == "local" or master.startswith("local[")
        root = "file:///tmp/checkpoints/taxoforge" if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, whose files go when the application ends."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stash(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and any executor may be lost.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished jobs now rather than when it next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key above total/HEAVY_PARTS rows counts as heavy, so there are fewer than HEAVY_PARTS heavy keys on any input.
HEAVY_PARTS = 1000


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join left to right, whose keys are unique and whose column ``weight`` counts the left rows of each key.

    Keys that hold over 1/HEAVY_PARTS of all ``total`` left rows are fewer than HEAVY_PARTS by pigeonhole: they are
    broadcast, so no task gathers them. The rest shuffles, none of its keys holding more than that share.
    ``how``: inner or left_semi.
    """
    bar = max(1, total // HEAVY_PARTS)
    heavy = F.broadcast(right.filter(F.col(weight) > bar))
    light = right.filter(F.col(weight) <= bar)
    hot = left.join(heavy, on, how)
    cold = left.join(F.broadcast(right.filter(F.col(weight) > bar).select(*on)), on, "left_anti").join(light.hint("merge"), on, how)
    return hot.unionByName(cold)
