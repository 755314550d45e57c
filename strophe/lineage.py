"""Checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one on a local master, and an error on a cluster, whose machines share no temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strophe-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute once, into the folder that all executors share, and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """A frame computed once, as Parquet in a folder of its own in the shared folder; `drop` deletes the folder when nothing reads it any more."""

    def __init__(self, df: DataFrame, kind: str):
        self.spark = df.sparkSession
        self.folder = f"{shared_dir(self.spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(self.folder)
        self.df = self.spark.read.schema(df.schema).parquet(self.folder)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver's JVM collect, so that Spark deletes the shuffle files of frames that nothing refers to any more; for loops whose rounds each leave some."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
