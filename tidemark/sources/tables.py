"""The driver's tables, read column by column, and the market roles they play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """Events of the types given as facts: id, at, instrument, event_type, price and k (of props)."""
    rows = table(spark, sf_dir, "events")
    if types:
        rows = rows.where(F.col("event_type").isin(*types))
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(F.col("event_id").alias("id"), micros(F.col("ts")).alias("at"), F.col("user_id").alias("instrument"), "event_type", F.col("value").alias("price"), k.alias("k"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as trades: id, at, instrument, price."""
    return events(spark, sf_dir, "purchase").select("id", "at", "instrument", "price")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as quotes: id, at, instrument, low_price, listing_count."""
    return events(spark, sf_dir, "view").select("id", "at", "instrument", F.col("price").alias("low_price"), F.col("k").alias("listing_count"))


def daily_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daily trades with unique keys: instrument (part), at, price and quantity."""
    rows = table(spark, sf_dir, "lineitem")
    day = rows.groupBy(F.col("l_partkey").alias("instrument"), micros(F.col("l_shipdate")).alias("at"))
    return day.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("sales"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims of forecasters: id, forecaster, at, direction (from priority), status, price."""
    direction = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "bullish").when(F.col("o_orderpriority") == "5-LOW", "bearish").otherwise("watch")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("forecaster"), micros(F.col("o_orderdate")).alias("at"), direction.alias("direction"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
