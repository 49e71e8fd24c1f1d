"""Structured Streaming: event files in, validated, deduplicated, routed, metered; windows as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import upsert
from ..session import shared_folder


def event_files(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 20) -> DataFrame:
    """A stream of a folder's event Parquet files whose names match, with ts as a timestamp."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def json_events(raw: DataFrame, schema: str, most_bytes: int = 65_536, column: str = "value") -> DataFrame:
    """raw with event (parsed, null where malformed) and reason: too_large, malformed or null."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    large = F.octet_length(column) > most_bytes
    broken = F.try_parse_json(column).isNull()
    return raw.withColumn("reason", F.when(large, "too_large").when(broken, "malformed")).withColumn("event", F.when(~large & ~broken, parsed))


def deduplicated(rows: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; a sink that must never repeat adds insert_absent()."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def tumbling(rows: DataFrame, length: str, by: list[str], delay: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums of value per window (sliding if slide is given) and key."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    found = rows.withWatermark("ts", delay).groupBy(window, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.unix_micros("window.start").alias("start"), *by, "n", "total")


def sessions(rows: DataFrame, gap: str, by: str, delay: str = "1 day") -> DataFrame:
    """Sessions of each key: events less than a gap apart."""
    found = rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return found.select(by, F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


def month_meter(rows: DataFrame, by: str, quantity: str) -> DataFrame:
    """Running month sums, for update mode."""
    month = F.date_trunc("month", "ts")
    return rows.groupBy(F.col(by), F.unix_micros(month).alias("month")).agg(F.sum(quantity).alias("quantity"))


def upsert_batches(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that keeps the last row of each key in versioned folders path/v{batch}, so that a batch that
    runs again writes the same version anew."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v{number - 1}"
        merged = upsert(spark.read.parquet(before), batch, keys, order) if number else batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        merged.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def run_to_table(rows: DataFrame, mode: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Run a stream over all there is and return the table it leaves in the shared folder.

    complete overwrites with each batch, update upserts by keys, append adds."""
    spark = rows.sparkSession
    base = shared_folder(spark, "stream")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        if mode == "update":
            upsert_batches(f"{base}/out", keys, order)(batch, number)
        elif mode == "complete":
            batch.write.mode("overwrite").parquet(f"{base}/out/v{number}")
        else:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        last.append(number)

    started = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    if not last:
        return spark.createDataFrame([], rows.schema)
    return spark.read.parquet(f"{base}/out").drop("batch") if mode == "append" else spark.read.parquet(f"{base}/out/v{last[-1]}")
