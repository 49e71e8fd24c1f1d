"""Places of rows in their groups, without a group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import written


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows (with _g, not null) with _pos, their place from 0 in their group by order, and _n, the group's rows.

    Places come from range partitions and the counts before them, so a group fills as many tasks as its rows need;
    rows equal in order stand as they were read, so that they too can be dealt out."""
    keys = [*order, F.col("_row").asc()]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    parts, _ = written(rows.repartitionByRange(F.col("_g"), *keys).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_g", "_part").agg(F.count("*").alias("_own"))
    whole = W.partitionBy("_g")
    before = F.coalesce(F.sum("_own").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_g", "_part", before.alias("_before"), F.sum("_own").over(whole).alias("_n"))
    place = F.row_number().over(W.partitionBy("_g", "_part").orderBy(*keys))
    return parts.withColumn("_place", place).join(counts, ["_g", "_part"]).withColumn("_pos", F.col("_before") + F.col("_place") - 1).drop("_part", "_row", "_place", "_before")
