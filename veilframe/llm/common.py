"""Small helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, by Spark's reader, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all machines share, which ``spark.checkpoint.dir`` names.

    Only a local session (a test) may leave it unset and gets a temporary folder; on a cluster
    that is an error, as a folder of one machine would not do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_text(name: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod``; a null id counts as ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod) == rest


def stash(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder, and read again.

    As :func:`cut`, but compressed and by column; for texts.
    """
    path = f"{shared_folder(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Returns freed memory of this Python process; a worker that waits for its next task needs none."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def give_back(spark: SparkSession) -> None:
    """Lets the driver return memory that nothing uses any more: plans and compiled classes of past queries, freed arrays.

    Both heaps of the driver otherwise keep what their largest step took.
    """
    gc.collect()
    trim()
    spark.sparkContext._jvm.java.lang.System.gc()


#: Keys with at least this part (one in ...) of all rows are heavy; there are no more of them than that.
HEAVY = 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with ``right``, whose ``keys`` are unique, so that no key is a hot one.

    ``weight``, a column of ``right`` that is not returned, is how many rows of ``left`` have the
    key. Heavy keys are ``HEAVY`` at most and are broadcast; all others are joined by shuffle.
    Both sides are read more than once, so they should be written tables.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY >= total
    hot = F.broadcast(right.where(heavy).drop(weight))
    rest = left.join(F.broadcast(right.where(heavy).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(right.where(~heavy).drop(weight), keys, how))


class Scratch:
    """A folder of intermediate tables below the shared folder, for one operator's run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.made = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again, with its lineage cut."""
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        """Removes the folder; nothing that was read from it may be used any more."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
