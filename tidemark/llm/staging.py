"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where none is set and Spark runs on this machine alone, as in tests, one is made."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint, without its lineage; for small tables, as checkpoints aren't compressed."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, compression: str | None = None) -> tuple[DataFrame, str]:
    """df written as a Parquet table in the checkpoint folder and read again, and the table's path."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs, and give back what the driver has freed.

    It does so when the driver's JVM has collected what refers to them; left to chance they pile up over
    the steps of one query. So does memory that the compiler, codecs and numpy have freed: the C library keeps it."""
    for _ in range(2):  # what the first collection finalises goes with the second
        gc.collect()
        spark._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    c = ctypes.CDLL(None)
    if hasattr(c, "malloc_trim"):  # glibc
        c.malloc_trim(0)
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """What jcmd's System.trim_native_heap does, for the driver's JVM, where that has it."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    args = array(jvm.Object, 4)
    for i, x in enumerate((command, "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0))):
        args[i] = x
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:  # by name, as Py4J sees the server's class alone, which its module hides
        jvm.org.apache.commons.lang3.reflect.MethodUtils.invokeMethod(server, "invoke", args)
    except Py4JJavaError:  # another JVM or system
        return


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint if it holds at most limit rows, else as it is, for a shuffle join.

    df should be cut first: it is counted, up to limit + 1 rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
