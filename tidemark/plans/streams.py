"""Streaming queries over the event file. Windows and sessions go beyond what the batch operators ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import arrivals
from ..streaming import ingest as streaming
from .catalog import query


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.event_files(spark, sf, "events.parquet")


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = streaming.tumbling(_stream(spark, sf), "6 hours", ["event_type"])
    return streaming.run_to_table(rows, "update", ["start", "event_type"], "n").withColumn("total", F.round("total", 4))


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 6 HOUR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(o) GROUP BY ALL")
def stream_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = streaming.tumbling(_stream(spark, sf), "12 hours", ["event_type"], slide="6 hours")
    return streaming.run_to_table(rows, "update", ["start", "event_type"], "n").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 8 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS r FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 8 HOUR) AS "end", count(*) AS n FROM r GROUP BY user_id, r""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.run_to_table(streaming.sessions(_stream(spark, sf), "8 hours", "user_id"), "complete")


@query("SELECT DISTINCT user_id, props->>'$.k' AS k FROM events WHERE event_type = 'signup'")
def stream_dedup_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf).where("event_type = 'signup'").withColumn("k", F.get_json_object("props", "$.k"))
    kept = streaming.deduplicated(rows, ["user_id", "k"], "40 days")
    return streaming.run_to_table(kept.select("user_id", "k", "ts"), "append").select("user_id", "k")


@query("SELECT user_id, epoch_us(date_trunc('month', ts)) AS month, sum((props->>'$.k')::BIGINT)::BIGINT AS quantity FROM events WHERE event_type = 'signup' GROUP BY ALL")
def stream_month_meter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf).where("event_type = 'signup'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return streaming.run_to_table(streaming.month_meter(rows, "user_id", "k"), "update", ["user_id", "month"], "quantity")


@query("""WITH t AS (SELECT event_id AS id, ts, user_id AS instrument, value AS price, (props->>'$.k')::BIGINT * 11 AS quantity, (event_id * 7919) % 100003 AS seq FROM events WHERE event_type = 'purchase'),
m AS (SELECT t.*, (SELECT CASE WHEN count(price) >= 3 THEN median(price) END FROM (SELECT price FROM t p WHERE p.instrument = t.instrument AND p.seq < t.seq ORDER BY p.ts DESC, p.id DESC LIMIT 7)) AS m FROM t)
SELECT id, round(m, 6) AS median_before, quantity > 1000 OR coalesce(m > 0 AND (price > m * 5 OR price < m * 0.2::DOUBLE), false) AS outlier, CASE WHEN quantity > 1000 THEN 'extreme_quantity' WHEN m > 0 AND (price > m * 5 OR price < m * 0.2::DOUBLE) THEN 'outside_rolling_median' END AS reason FROM m""")
def stream_outlier_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases that arrive in another order than they were made, each flagged by what had arrived before it."""
    c = F.col
    rows = _stream(spark, sf).where("event_type = 'purchase'")
    records = rows.select(c("user_id").alias("instrument"), (c("event_id") * 7919 % 100003).alias("seq"), c("event_id").alias("id"), F.unix_micros("ts").alias("at"), c("value").alias("price"), (F.get_json_object("props", "$.k").cast("long") * 11).alias("quantity"))
    with arrivals.state_in_rocksdb(spark):
        return streaming.run_to_table(arrivals.outlier_flags(records, "instrument"), "append").withColumn("median_before", F.round("median_before", 6))
