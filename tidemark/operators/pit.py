"""Point-in-time joins. Facts have at (microseconds), id and value columns; nothing sees beyond its instant.

Every operator is one shuffle by key. Ties on at go to the larger id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import DAY

ORDER = ("at", "id")


def newest(values: Sequence[str], where: Column | None = None, order: Sequence[str] = ORDER) -> Column:
    """Aggregate: the values of the newest row (that meets where) as a struct. The row is chosen before its values
    are looked at, so a newest row with a null price gives a null price."""
    row = F.struct(*values)
    by = F.struct(*order)
    if where is not None:
        by = F.when(where, by)
    return F.max_by(row, by)


def latest_asof(facts: DataFrame, keys: Sequence[str], asof: Column, values: Sequence[str]) -> DataFrame:
    """The newest fact of each key at or before asof: keys and values."""
    found = facts.where(F.col("at") <= asof).groupBy(*keys).agg(newest(values).alias("_row"))
    return found.select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])


def latest_at(facts: DataFrame, key: str, instants: Sequence[Column], value: str) -> DataFrame:
    """key, days and values of keys with a fact at or before the last of a few ascending instants. Arrays: values has the newest value at
    or before each instant (null if none), days the number of facts up to it. Facts have unique (key, at).

    Facts are combined by the instants that they lie between: one shuffle of a narrow row per key, stretch and task, and one of
    a row per key and stretch, where a join would sort all facts, once for every set of instants."""
    slot = sum(((F.col("at") > t).cast("int") for t in instants[:-1]), F.lit(0))
    stretches = facts.where(F.col("at") <= instants[-1]).groupBy(key, slot.alias("_slot")).agg(F.max_by(value, "at").alias("_value"), F.count("*").alias("_n"))
    upto = [F.col("_slot") <= i for i in range(len(instants))]
    return stretches.groupBy(key).agg(F.array(*[F.max_by("_value", F.when(u, F.col("_slot"))) for u in upto]).alias("values"), F.array(*[F.coalesce(F.sum(F.when(u, F.col("_n"))), F.lit(0)) for u in upto]).alias("days"))


def asof_join(probes: DataFrame, facts: DataFrame, key: str, values: Sequence[str], prefix: str = "asof_", chunk: int | None = 30 * DAY) -> DataFrame:
    """probes with the values of the newest fact of their key at or before their at.

    Probes and facts are sorted together and the newest fact is carried along: linear in both, where a join on
    key and range would multiply long histories. probes need at and key; all their columns stay.

    A key's rows are dealt out by time, in chunks of so many microseconds: the newest fact is carried within each
    chunk, and into it from the chunks before by a table of one row per key and chunk. A key that holds a
    large part of all rows thus fills many tasks and no single one. None leaves keys whole."""
    fact = F.struct("at", *values)
    kind = facts.select(fact.alias("r")).schema["r"].dataType
    left = probes.select(key, "at", F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_fact"), F.struct("*").alias("_probe"), F.lit(None).cast("long").alias("_id"))
    right = facts.select(key, "at", F.lit(0).alias("_kind"), fact.alias("_fact"), F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), F.col("id").cast("long").alias("_id"))
    both, keys = left.unionByName(right), [key]
    if chunk:
        both, keys = both.withColumn("_chunk", F.floor(F.col("at") / chunk)), [key, "_chunk"]
    carried = F.last("_fact", ignorenulls=True).over(W.partitionBy(*keys).orderBy("at", "_kind", "_id").rowsBetween(W.unboundedPreceding, 0))
    seen = both.withColumn("_seen", carried).where("_kind = 1")
    if chunk:
        closing = both.groupBy(*keys).agg(F.max_by("_fact", F.when(F.col("_kind") == 0, F.struct("at", "_id"))).alias("_last"))
        before = F.last("_last", ignorenulls=True).over(W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
        seen = seen.join(closing.select(*keys, before.alias("_before")), keys, "left").withColumn("_seen", F.coalesce("_seen", "_before"))
    return seen.select("_probe.*", *[F.col(f"_seen.{v}").alias(prefix + v) for v in values])


def by_preference(facts: DataFrame, keys: Sequence[str], asof: Column, kinds: Sequence[Column], value: str) -> DataFrame:
    """The newest value as of asof of the first kind that has one: keys, value, choice (the kind's number, from 1)."""
    picks = [newest([value], k & (F.col("at") <= asof)).alias(f"_k{i}") for i, k in enumerate(kinds)]
    found = facts.groupBy(*keys).agg(*picks)
    parts = [F.col(f"_k{i}.{value}") for i in range(len(kinds))]
    choice = F.coalesce(*[F.when(p.isNotNull(), F.lit(i + 1)) for i, p in enumerate(parts)])
    return found.select(*keys, F.coalesce(*parts).alias(value), choice.alias("choice"))


def period_slack(days: float) -> float:
    """A quarter of the period, a day at least."""
    return max(1.0, 0.25 * days)


def band(asof: Column, back_days: float, slack_days: float) -> Column:
    """at in the closed band [asof - back - slack, asof - back]."""
    end = asof - int(back_days * DAY)
    return F.col("at").between(end - int(slack_days * DAY), end)


def period_returns(trades: DataFrame, keys: Sequence[str], asof: Column, periods: Sequence[int]) -> DataFrame:
    """ret_{p}d and status_{p}d of each key: last trade near asof over last trade near asof - p days, less 1.

    insufficient_data (and a null return) where either is missing, both are one trade, or the start isn't positive."""
    seen = trades.where(F.col("at") <= asof)
    picks = []
    for p in periods:
        slack = period_slack(p)
        picks += [newest(["id", "price"], band(asof, 0, slack)).alias(f"_e{p}"), newest(["id", "price"], band(asof, p, slack)).alias(f"_s{p}")]
    found = seen.groupBy(*keys).agg(F.count("*").alias("n_trades"), *picks)
    columns = []
    for p in periods:
        start, end = F.col(f"_s{p}"), F.col(f"_e{p}")
        ok = start.isNotNull() & end.isNotNull() & (start["id"] != end["id"]) & (start["price"] > 0)
        columns += [F.when(ok, end["price"] / start["price"] - 1).alias(f"ret_{p}d"), F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("insufficient_data").alias(f"status_{p}d")]
    return found.select(*keys, "n_trades", *columns)


def window_join(probes: DataFrame, facts: DataFrame, key: str, after: Column, until: Column, width: int) -> DataFrame:
    """probes with the facts (f_at, f_id, f_price) of their key in (after, until]; probes without any stay, with nulls.

    Both sides are dealt out by key and time, in buckets of width microseconds, and a probe goes to each bucket
    that its window meets: facts of other times are never compared. Equal probes are joined once; _copies counts them."""
    once = probes.groupBy(*probes.columns).agg(F.count("*").alias("_copies"))
    buckets = F.sequence(F.floor((after + 1) / width), F.greatest(F.floor(until / width), F.floor((after + 1) / width)))
    left = once.withColumn("_bucket", F.explode_outer(buckets))
    right = facts.select(F.col(key).alias("_k"), F.floor(F.col("at") / width).alias("_b"), F.col("at").alias("f_at"), F.col("id").alias("f_id"), F.col("price").alias("f_price"))
    return left.join(right, (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")) & (F.col("f_at") > after) & (F.col("f_at") <= until), "left")


def window_values(joined: DataFrame, columns: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """One row of values for each probe of window_join, equal probes each with their own. Values see null facts."""
    found = joined.groupBy(*columns, "_copies").agg(*values)
    return found.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).drop("_copies")


def forward_window(claims: DataFrame, facts: DataFrame, key: str, horizon: int, values: Sequence[Column]) -> DataFrame:
    """claims with aggregates over the facts of their key in (at, at + horizon]; claims without any stay, with nulls.

    Aggregates see the facts as columns f_at, f_id and f_price. claims need at and the key."""
    joined = window_join(claims, facts, key, F.col("at"), F.col("at") + horizon, horizon)
    return window_values(joined, claims.columns, values)


def valid_at(intervals: DataFrame, t: Column, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Rows in force at t: start <= t < end, an open end never ending."""
    return intervals.where((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))
