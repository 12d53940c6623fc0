"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut as cut
from ..functions.lineage import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back: compact and by columns, for what is read several times."""
    return written(df, scratch(df.sparkSession, name), compression)


def written(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """As stored, at a path in a folder from ``scratch``; Spark packs small files into few tasks when it reads them, so that a step over little data takes few."""
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what ``written`` or ``stored`` wrote, when nothing reads it any more."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def release(spark: SparkSession, wait: float = 1.0) -> None:
    """Let Spark remove the shuffle files and checkpoints of frames that nothing refers to any more, which it does when the driver collects its garbage: between two large jobs their sum need not fit the disks."""
    for _ in range(2):  # Python's references go first, then those of the JVM
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(wait)


def row_key() -> Column:
    """An inner key of a row, never null: equal for repeated rows of an id and a text only."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
