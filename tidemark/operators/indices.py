"""Baskets: qualification, weights, interval membership, base-100 levels, benchmark choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import DAY

DEFINITION = "index_key string, kind string, brand string, min_sales int, min_history int, method string, mixed boolean"


def qualify(definitions: DataFrame, instruments: DataFrame, counts: DataFrame) -> DataFrame:
    """(index_key, instrument, sales, method) of the instruments that meet each definition.

    A null in a definition's kind or brand matches anything; a definition without a kind has no members
    unless it is mixed. definitions is a catalog of some tens of rows and is broadcast; counts has
    instrument, sales (in the window) and history, and may have step, which stays."""
    wild = lambda c: F.col(f"d.{c}").isNull() | (F.col(f"d.{c}") == F.col(f"i.{c}"))
    counted = instruments.join(counts, "instrument")
    found = counted.alias("i").join(F.broadcast(definitions).alias("d"), wild("kind") & wild("brand") & (F.col("d.kind").isNotNull() | F.col("d.mixed")))
    return found.where("sales >= min_sales and history >= min_history").select("index_key", "instrument", "sales", "method", *[c for c in ("step",) if c in counts.columns])


def weights(members: DataFrame, by: Sequence[str] = ("index_key",)) -> DataFrame:
    """members with weight: equal, or by sales where the method is liquidity and there are any; 8 decimals.

    Totals are one row per definition and broadcast, so that no index, however large, is one task's."""
    totals = members.groupBy(*by).agg(F.sum("sales").alias("_total"), F.count("*").alias("_members"))
    by_sales = (F.col("method") == "liquidity") & (F.col("_total") > 0)
    weight = F.when(by_sales, F.col("sales") / F.col("_total")).otherwise(1.0 / F.col("_members"))
    return members.join(F.broadcast(totals), list(by)).withColumn("weight", F.round(weight, 8)).drop("_total", "_members")


def rebalance_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(index_key, instrument, change): left, joined or stayed."""
    keys = ["index_key", "instrument"]
    both = before.select(*keys, F.lit(1).alias("b")).join(after.select(*keys, F.lit(1).alias("a")), keys, "full")
    return both.select(*keys, F.when(F.col("a").isNull(), "left").when(F.col("b").isNull(), "joined").otherwise("stayed").alias("change"))


def timeline(dated: DataFrame, dates: DataFrame) -> DataFrame:
    """Interval memberships from qualified members at rebalance dates: index_key, instrument, weight, effective_from, effective_to.

    dated has index_key, instrument, step, weight; dates has step (0, 1, ...) and at. Members who stay keep
    their weight: a run of consecutive steps is one interval with the weight of its first."""
    order = W.partitionBy("index_key", "instrument").orderBy("step")
    runs = dated.withColumn("run", F.col("step") - F.row_number().over(order)).groupBy("index_key", "instrument", "run").agg(F.min_by("weight", "step").alias("weight"), F.min("step").alias("first"), (F.max("step") + 1).alias("next"))
    start, end = dates.select(F.col("step").alias("first"), F.col("at").alias("effective_from")), dates.select(F.col("step").alias("next"), F.col("at").alias("effective_to"))
    return runs.join(F.broadcast(start), "first").join(F.broadcast(end), "next", "left").select("index_key", "instrument", "weight", "effective_from", "effective_to")  # one row per date


def level(members: DataFrame, by: Sequence[str] = ("index_key",)) -> DataFrame:
    """Level of each index (by) from members with weight, base and current price: base 100, weights renormalised over what is priced."""
    priced = F.col("base").isNotNull() & F.col("current").isNotNull() & (F.col("base") > 0)
    relative = F.when(priced, F.col("weight") * F.col("current") / F.col("base"))
    found = members.groupBy(*by).agg(F.count("*").alias("members"), F.count_if(priced).alias("priced"), F.sum(relative).alias("_r"), F.sum(F.when(priced, F.col("weight"))).alias("_w"))
    coverage = F.col("priced") / F.col("members")
    quality = F.when(F.col("priced") == 0, "insufficient_data").when(coverage >= 0.8, "complete").otherwise("partial")
    return found.select(*by, "members", "priced", F.when(F.col("priced") > 0, 100 * F.col("_r") / F.col("_w")).otherwise(100.0).alias("level"), coverage.alias("coverage"), quality.alias("quality"))


def inception(memberships: DataFrame) -> DataFrame:
    """index_key, inception (the first effective_from of any member) and instruments, the number of members over all time."""
    return memberships.groupBy("index_key").agg(F.min("effective_from").alias("inception"), F.countDistinct("instrument").alias("instruments"))


def first_match(rows: DataFrame, candidates: DataFrame, key: str, rank: str = "prio", tie: str = "index_key") -> DataFrame:
    """rows with the best of their candidates by rank and tie; rows without any stay, with nulls."""
    best = candidates.groupBy(key).agg(F.min_by(F.struct(tie, rank), F.struct(rank, tie)).alias("_b"))
    return rows.join(best, key, "left").select(*rows.columns, F.col(f"_b.{tie}").alias(tie), F.col(f"_b.{rank}").alias(rank))


def simple_return(start: Column, end: Column) -> Column:
    """end / start - 1, null where start isn't positive."""
    return F.when(start > 0, end / start - 1)


def market_levels(trades: DataFrame, group: Column) -> DataFrame:
    """Mean daily close of each group's instruments, as a level: index_key, at (the day's end), id, level."""
    day = F.floor(F.col("at") / DAY)
    close = trades.withColumn("index_key", group).groupBy("index_key", "instrument", day.alias("day")).agg(F.max_by("price", F.struct("at", "id")).alias("close"))
    return close.groupBy("index_key", "day").agg(F.avg("close").alias("level")).select("index_key", ((F.col("day") + 1) * DAY - 1).alias("at"), F.col("day").alias("id"), "level")
