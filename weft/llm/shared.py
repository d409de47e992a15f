"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master, where it may be unset, a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return context.getCheckpointDir()


#: Rows and bytes of a batch that Spark hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 250, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands texts to Python in batches that bound a worker's memory."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: computed once, and independent of lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
