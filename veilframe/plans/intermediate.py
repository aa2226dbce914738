"""Intermediate results that are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that what reads it does not compute it again.

    ``spark.checkpoint.dir`` names a folder that all machines share; only a local session may
    leave it unset and gets a temporary one.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def streamed(df: DataFrame) -> DataFrame:
    """What a streaming ``df`` gives for the input that is there now, written to the shared folder and read again."""
    spark = df.sparkSession
    place = f"{_shared(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    running = df.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out")


def dealt(df: DataFrame) -> DataFrame:
    """A small input that has fewer partitions than four a core, dealt over all cores; else ``df``.

    Small files hold one row group, which one task would read and work on alone. A large input
    has many and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 4 * cores else df
