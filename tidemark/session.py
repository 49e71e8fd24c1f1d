"""A session with the settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution with skew-join splitting; shuffle_partitions only where AQE shouldn't choose."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()


def materialised(df: DataFrame) -> DataFrame:
    """df written as a table of the shared folder and read again: for what several branches of a plan need."""
    path = shared_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster shares (spark.checkpoint.dir); where none is set and Spark runs on this machine alone, under a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = spark.sparkContext.getCheckpointDir()
    return f"{known}/{name}-{uuid.uuid4().hex}"
