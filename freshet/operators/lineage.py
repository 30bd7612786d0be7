"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where that is unset, a local master takes a temporary folder and a cluster a folder in the
    warehouse; a warehouse on local disks isn't shared by executors and is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (sc.master == "local" or sc.master.startswith("local[")):
            shared = tempfile.mkdtemp(prefix="checkpoints-")
        if not shared:
            shared = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
            if shared.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the checkpoint folder.

    Files go when Spark's cleaner drops them, if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Written:
    """A table written once as Parquet in the checkpoint folder, which all executors share.

    For loops: a checkpoint keeps the size that Spark had guessed for its plan, and guesses of joins of
    joins grow until planning stands still, while a table has the size of its files. drop() deletes them;
    until then anything computed from the table can be computed again.
    """

    def __init__(self, df: DataFrame):
        sc = df.sparkSession.sparkContext
        self.path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.table = df.sparkSession.read.schema(df.schema).parquet(self.path)
        self._at = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        self._conf = sc._jsc.hadoopConfiguration()

    def drop(self) -> None:
        self._at.getFileSystem(self._conf).delete(self._at, True)


def written(df: DataFrame) -> DataFrame:
    """df, written once."""
    return Written(df).table


def release(df: DataFrame) -> None:
    """Asks the driver for a garbage collection, so that Spark's cleaner drops shuffles and checkpoints no longer in use.

    For loops that write much in every round; without it their files stay until the driver happens to collect.
    """
    df.sparkSession.sparkContext._jvm.System.gc()
