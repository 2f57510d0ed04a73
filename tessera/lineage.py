"""Cutting lineage: rows written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Most rows that are kept in one partition, and of which what is made of them goes to every task.
MOST_IN_ONE = 20_000
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the folder that all executors share, without their lineage.

    The folder is the session's spark.checkpoint.dir; one is made only where that is
    unset and all runs on this machine. A checkpoint keeps the size that its plan was
    thought to have, which multiplies from join to join and from round to round until
    planning itself takes minutes; so the rows are read back without it. The shuffle
    files behind the rows go as soon as these are written.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        own = df.select("*")  # a plan made while the setting holds
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    rows = own.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), spark)


def rows_of(made: DataFrame) -> int:
    """How many rows a checkpoint has, without an exchange."""
    return made._jdf.queryExecution().toRdd().count()


def in_one(rows: DataFrame, small: bool) -> DataFrame:
    """Small tables in one partition: nothing that is done with them moves rows, and takes one task.

    Every exchange costs the driver a thread, up to 1024 of them.
    """
    return rows.coalesce(1) if small else rows


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
