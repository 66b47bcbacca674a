"""Broadcasts behind a check of size, lineage cuts, and numbers of rows without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast.
LIMIT = 20_000
#: Whether Spark drops the files of a plan's shuffles when the plan has run, and not only when a collection finds them unused.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def broadcast_if_small(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a plain local session without it gets a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir") or None
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lyceum-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, where a checkpoint computes twice, and read by column. What it shuffled goes with the end of its writing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` over two tasks a core if it comes in fewer partitions than there are cores, as from one file; a larger input stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0 and without gaps: ranges are sorted apart, their sizes carry the count on."""
    ranges = checkpointed(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = ranges.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_p", "_before")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return ranges.withColumn("_r", own).join(F.broadcast(sizes), "_p").withColumn(out, (F.col("_before") + F.col("_r")).cast("long")).drop("_p", "_r", "_before")
