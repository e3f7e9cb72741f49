"""Replay-safe batch sinks and where streaming state lives."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only in local mode, as in a test, a temporary one is made
    where none is named: on a cluster, each executor would have a folder of its own behind that name."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="jobtide-")
    return f"{root.rstrip('/')}/jobtide-{uuid.uuid4().hex}"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store; state then is bounded by disk, not by heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Rows of one micro-batch in the folder ``batch_id=N``. A batch that is run again replaces the folder."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch_id={batch_id}")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory())


def drop_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Removes the folder of a batch that nothing reads any more, if it is there."""
    drop_folder(spark, f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """All batches, or those before one; None when nothing was written yet."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def start(writer: DataStreamWriter, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """``trigger``: keyword arguments of ``DataStreamWriter.trigger``; by default what is there, then stop."""
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
