"""Exact order statistics of every group at once, without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialised

#: Values that are gathered of one group at most; a group with fewer is done at once.
GATHER = 4096
#: Splitters of a round: each round leaves about a SPLIT-th of a group's values in question.
SPLIT = 64


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def _bracketed(rows: DataFrame, state: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str]) -> DataFrame:
    """The values of each group of state that are in its bracket, with state's columns."""
    held = state.select(*[F.col(k).alias(f"_{k}") for k in keys], *columns, "_low", "_high")
    inside = F.col("_low").isNull() | F.col(value).between(F.col("_low"), F.col("_high"))
    return rows.select(*keys, value).where(F.col(value).isNotNull()).join(held, _same(keys)).where(inside)


def group_medians(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median", gather: int = GATHER, split: int = SPLIT) -> DataFrame:
    """keys and the exact median of value in each group (the mean of the middle two where their number is even).

    Groups of gather values or fewer are sorted as arrays. Of the others, each round takes split splitters from a mergeable quantile
    sketch and the least value, counts the values between them exactly, and keeps the one stretch that holds the middle (each
    round settles the least value at the very least, and by the sketch's bounds all but some 2 / split of the values); all groups
    are in the round together, and both aggregates are combined before the shuffle. A stretch of gather values is then
    sorted as an array; one whose least and largest value are equal is the median, however many rows it has. The driver sees the
    number of groups in question alone. rows is read again in each round: two for a group of a million values.

    Defined cases: null values don't count; a group of nulls alone has a null median; a null key is a key; no rows give no groups."""
    counts = rows.groupBy(*keys).agg(F.count(value).alias("_n"))
    state = materialised(counts.withColumns({"_k1": F.floor((F.col("_n") - 1) / 2), "_k2": F.floor(F.col("_n") / 2), "_below": F.lit(0).cast("long"), "_in": F.col("_n"), "_low": F.lit(None).cast("double"), "_high": F.lit(None).cast("double")}))
    done = [state.where("_n = 0").select(*keys, F.lit(None).cast("double").alias(name))]
    held = rows.withColumn(value, F.col(value).cast("double"))
    cut = F.array(*[F.lit(i / split) for i in range(1, split)])
    while True:
        few = state.where((F.col("_n") > 0) & (F.col("_in") <= gather))
        listed = _bracketed(held, few, keys, value, ("_k1", "_k2", "_below")).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_all"), *[F.max(c).alias(c) for c in ("_k1", "_k2", "_below")])
        at = lambda k: F.get("_all", (F.col(k) - F.col("_below")).cast("int"))
        done.append(listed.select(*keys, ((at("_k1") + at("_k2")) / 2).alias(name)))
        many = state.where(F.col("_in") > gather)
        if many.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), done)
        ends = _bracketed(held, many, keys, value, ()).groupBy(*keys).agg(F.concat(F.array(F.min(value)), F.percentile_approx(value, cut, split * 16)).alias("_cuts"))
        # written: it is small, and both of the round's joins read it
        many = materialised(many.join(ends.select(*[F.col(k).alias(f"_{k}") for k in keys], "_cuts"), _same(keys)).select(*many.columns, "_cuts"))
        found = _bracketed(held, many, keys, value, ("_cuts",)).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
        found = found.groupBy(*keys, "_bucket").agg(F.count("*").alias("_count"), F.min(value).alias("_least"), F.max(value).alias("_most"))
        before = F.coalesce(F.sum("_count").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        met = found.withColumn("_before", before).join(many.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", "_k1", "_k2", "_below"), _same(keys))
        has = lambda k: (F.col(k) >= F.col("_below") + F.col("_before")) & (F.col(k) < F.col("_below") + F.col("_before") + F.col("_count"))
        # where the middle two lie in two stretches, they are the last of one and the first of the next
        ranks = met.where(has("_k1") | has("_k2")).groupBy(*keys).agg(
            *[F.max(c).alias(c) for c in ("_n", "_k1", "_k2")], F.count("*").alias("_stretches"), F.max(F.when(has("_k1"), F.col("_most"))).alias("_last"), F.max(F.when(has("_k2"), F.col("_least"))).alias("_first"),
            F.max(F.col("_below") + F.col("_before")).alias("_below"), F.max("_count").alias("_in"), F.min("_least").alias("_low"), F.max("_most").alias("_high"),
        )
        ranks = materialised(ranks)
        settled = (F.col("_stretches") == 2) | (F.col("_low") == F.col("_high"))
        done.append(ranks.where(settled).select(*keys, ((F.col("_last") + F.col("_first")) / 2).alias(name)))
        state = ranks.where(~settled).select(*state.columns)


def group_mads(rows: DataFrame, keys: Sequence[str], value: str, gather: int = GATHER, split: int = SPLIT) -> DataFrame:
    """keys, median and mad: the median distance from the median, both exact."""
    middle = materialised(group_medians(rows, keys, value, "median", gather, split))
    held = middle.select(*[F.col(k).alias(f"_{k}") for k in keys], "median")
    apart = rows.select(*keys, value).join(held, _same(keys)).select(*keys, F.abs(F.col(value) - F.col("median")).alias(value))
    spread = group_medians(apart, keys, value, "mad", gather, split)
    return spread.select(*[F.col(k).alias(f"_{k}") for k in keys], "mad").join(middle, _same(keys)).select(*keys, "median", "mad")
