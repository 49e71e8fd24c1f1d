"""Streams over several files: late rows, repeats, upserts across batches."""

from pyspark.sql import functions as F

from tidemark.streaming import arrivals
from tidemark.streaming import ingest as streaming

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, folder, name, rows):
    frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    frame.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def test_counts_are_upserted_over_batches(spark, tmp_path):
    write(spark, tmp_path, "a", [(1, "2024-01-01 00:10:00", 1, "x", 1.0, "{}"), (2, "2024-01-01 00:20:00", 1, "x", 2.0, "{}")])
    write(spark, tmp_path, "b", [(3, "2024-01-01 00:50:00", 1, "x", 4.0, "{}"), (4, "2024-01-01 01:10:00", 1, "x", 8.0, "{}")])
    out = streaming.run_to_table(streaming.tumbling(stream(spark, tmp_path), "1 hour", ["event_type"]), "update", ["start", "event_type"], "n")
    assert sorted((r.n, r.total) for r in out.collect()) == [(1, 8.0), (3, 7.0)]


def test_repeats_in_later_batches_are_dropped(spark, tmp_path):
    write(spark, tmp_path, "a", [(1, "2024-01-01 00:10:00", 1, "x", 1.0, "{}"), (1, "2024-01-01 00:10:00", 1, "x", 1.0, "{}")])
    write(spark, tmp_path, "b", [(1, "2024-01-01 00:11:00", 1, "x", 1.0, "{}"), (2, "2024-01-01 00:12:00", 2, "x", 1.0, "{}")])
    kept = streaming.deduplicated(stream(spark, tmp_path), ["event_id"], "1 day").select("event_id")
    out = streaming.run_to_table(kept, "append")
    assert sorted(r.event_id for r in out.collect()) == [1, 2]


def test_sessions_close_after_the_gap(spark, tmp_path):
    write(spark, tmp_path, "a", [(1, "2024-01-01 00:00:00", 1, "x", 1.0, "{}"), (2, "2024-01-01 00:20:00", 1, "x", 1.0, "{}"), (3, "2024-01-01 02:00:00", 1, "x", 1.0, "{}")])
    out = streaming.run_to_table(streaming.sessions(stream(spark, tmp_path), "30 minutes", "user_id"), "complete")
    assert sorted(r.n for r in out.collect()) == [1, 2]


def test_no_files_give_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    out = streaming.run_to_table(streaming.month_meter(stream(spark, tmp_path / "none"), "user_id", "value"), "update", ["user_id", "month"], "quantity")
    assert out.count() == 0


RECORD = "key string, seq long, id long, at long, price double, quantity long"


def record_stream(spark, folder):
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_outliers_in_order_of_arrival_over_batches_and_replays(spark, tmp_path):
    """Later arrivals of earlier times count; a replay is flagged as before and not counted; a restart goes on with the state."""
    day = 86_400_000_000
    first = [("k", 1, 1, 10 * day, 40.0, 1), ("k", 2, 2, 11 * day, 42.0, 1), ("k", 3, 3, 9 * day, 41.0, 1), ("k", 4, 4, 12 * day, 400.0, 1), ("j", 5, 5, day, 1.0, 2000)]
    second = [("k", 6, 4, 12 * day, 400.0, 1), ("k", 7, 6, 8 * day, 7.0, 1), ("k", 8, 7, 13 * day, None, None), ("z", 9, 8, day, 0.0, 1)]
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        flags = arrivals.outlier_flags(record_stream(spark, folder), "key")
        with arrivals.state_in_rocksdb(spark):
            flags.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, r.median_before, r.outlier, r.reason) for r in spark.read.parquet(out).collect())

    spark.createDataFrame(first, RECORD).coalesce(1).write.mode("append").parquet(str(folder))
    expected = [(1, None, False, None), (2, None, False, None), (3, None, False, None), (4, 41.0, True, "outside_rolling_median"), (5, None, True, "extreme_quantity")]
    assert run() == expected
    spark.createDataFrame(second, RECORD).coalesce(1).write.mode("append").parquet(str(folder))
    more = [(4, 41.0, True, "outside_rolling_median"), (6, 41.5, True, "outside_rolling_median"), (7, 41.0, False, None), (8, None, False, None)]
    assert sorted(run(), key=repr) == sorted(expected + more, key=repr)


def test_records_that_arrive_at_once_are_not_before_each_other(spark, tmp_path):
    day = 86_400_000_000
    rows = [("k", seq, i, i * day, price, 1) for i, (seq, price) in enumerate([(1, 10.0), (1, 12.0), (1, 500.0), (2, 14.0), (2, 1.0), (3, 2.0)], 1)]
    spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(str(tmp_path / "in"))
    with arrivals.state_in_rocksdb(spark):
        out = streaming.run_to_table(arrivals.outlier_flags(record_stream(spark, tmp_path / "in"), "key"), "append")
    assert sorted((r.id, r.median_before, r.outlier) for r in out.collect()) == [(1, None, False), (2, None, False), (3, None, False), (4, 12.0, False), (5, 12.0, True), (6, 12.0, True)]
