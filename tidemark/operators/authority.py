"""Track records of forecasters by slice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import authority_score, authority_weight, beta_mean, half_life, trust_state, wilson_high, wilson_low
from ..functions.times import DAY
from ..session import materialised
from .selection import GATHER, group_medians

SLICE = ("game", "language", "set_key", "tier", "horizon")


def latest_trust(events: DataFrame, key: str) -> DataFrame:
    """(key, trust): the state of each forecaster's newest trust event (at, id, state)."""
    return events.groupBy(key).agg(F.max_by("state", F.struct("at", "id")).alias("trust"))


def sliced(calls: DataFrame, by: Sequence[str] = SLICE) -> DataFrame:
    """Each call once for each of its slices: the whole, game and language, and the full slice."""
    rows = calls.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by})
    levels = [(), tuple(by[:2]), tuple(by)]
    each = F.array(*[F.struct(*[(F.col(c) if c in level else F.lit("*")).alias(c) for c in by]) for level in levels])
    return rows.withColumn("_slice", F.explode(each)).drop(*by).select("*", "_slice.*")


def _records(rows: DataFrame, key: str, asof: Column, by: Sequence[str], gather: int | None) -> DataFrame:
    """Counts, means and medians of each slice of rows; without gather the returns of a slice are sorted as one array."""
    hit = (F.col("verdict") == "correct").cast("int")
    directional = F.col("verdict").isin("correct", "incorrect")
    weight = half_life((asof - F.col("at")) / DAY)
    stated = directional & F.col("confidence").isNotNull()
    listed = [] if gather is not None else [F.array_sort(F.collect_list(F.col("ret").cast("double"))).alias("_all")]
    found = rows.groupBy(key, *by).agg(
        F.count("*").alias("calls"), F.count_if(directional).alias("n"), F.count_if(F.col("verdict") == "correct").alias("k"), F.avg("ret").alias("mean_return"), F.avg("relative").alias("mean_relative"),
        (F.sum(F.when(directional, weight * hit)) / F.sum(F.when(directional, weight))).alias("recency_accuracy"), F.avg(F.when(stated, (F.col("confidence") - hit) * (F.col("confidence") - hit))).alias("calibration"), *listed,
    )
    if gather is None:
        n = F.size("_all")
        at = lambda i: F.get("_all", F.floor(i / 2).cast("int"))
        return found.withColumn("median_return", (at(n - 1) + at(n)) / 2).drop("_all")
    medians = group_medians(rows, [key, *by], "ret", "median_return", gather)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (key, *by)])
    return found.join(medians.select(*[F.col(k).alias(f"_{k}") for k in (key, *by)], "median_return"), same).select(*found.columns, "median_return")


def slices(calls: DataFrame, trust: DataFrame, key: str, asof: Column, by: Sequence[str] = SLICE, gather: int = GATHER) -> DataFrame:
    """A record for each forecaster's calls as a whole, by game and language, and by the full slice.

    calls: key, at, the columns of by, verdict (correct, incorrect or else), ret, relative, confidence (stated or null).
    trust: key and trust, where excluded wins over the record. The calls of a forecaster with gather calls
    at most are shuffled once, by the forecaster, and go to their three slices there. Those of the others go to their slices first, which
    are combined before the shuffle, and the exact median of their returns comes from rounds of selection, so that no
    large slice is gathered. A slice's absent columns are '*'; of calls that lack them they are ''."""
    many = materialised(calls.groupBy(key).agg(F.count("*").alias("_calls")).where(F.col("_calls") > gather).select(F.col(key).alias("_many")))
    if many.isEmpty():
        found = _records(sliced(calls.repartition(key), by), key, asof, by, None)
    else:
        has = lambda how: calls.join(many, F.col(key).eqNullSafe(F.col("_many")), how)
        found = _records(sliced(has("left_anti").repartition(key), by), key, asof, by, None).unionByName(_records(sliced(has("left_semi"), by), key, asof, by, gather))
    n, k = F.col("n"), F.col("k")
    some = lambda c: F.when(n > 0, c)
    low = wilson_low(k, n)
    found = found.join(trust, key, "left").withColumn("state", trust_state(n, low, F.coalesce(F.col("trust") == "excluded", F.lit(False)))).drop("trust")
    return found.withColumns({"accuracy": some(k / n), "wilson_low": some(low), "wilson_high": some(wilson_high(k, n)), "bayes_mean": some(beta_mean(k, n)), "score": authority_score(n, low, F.col("mean_return")), "weight": authority_weight(n, low, F.col("state"))})
