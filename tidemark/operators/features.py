"""The as-of feature vector of every instrument at once, with missing kept apart from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ladder
from ..functions.times import DAY, trailing
from .pit import band, newest, period_slack
from .series import array_mad, array_median, ema

METHOD = "features.v1"
PERIODS = (1, 7, 30, 90, 180, 365)


def velocity(at: Column, asof: Column, keep: Column | None = None) -> dict[str, Column]:
    """Aggregates: trades in the last 1, 7 and 30 days, in the 7 days before the last 7, and per day over 30."""
    ok = keep if keep is not None else F.lit(True)
    n = lambda days, lag=0: F.count_if(ok & trailing(at, asof, days, lag))
    return {"n1": n(1), "n7": n(7), "n30": n(30), "prior7": n(7, 7), "per_day": n(30) / 30.0}


def momentum_of_volume() -> Column:
    """n7 / prior7 - 1 where both are at least 2."""
    return F.when((F.col("n7") >= 2) & (F.col("prior7") >= 2), F.col("n7") / F.col("prior7") - 1)


def supply(quotes: DataFrame, asof: Column) -> DataFrame:
    """Newest quote of each instrument and its change on the one before: listing_count, listing_prev, low_now, low_prev."""
    rank = F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("at"), F.desc("id")))
    top = quotes.where(F.col("at") <= asof).withColumn("_r", rank).where("_r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
    return top.groupBy("instrument").agg(pick("listing_count", 1).alias("listing_count"), pick("listing_count", 2).alias("listing_prev"), pick("low_price", 1).alias("low_now"), pick("low_price", 2).alias("low_prev"))


def source_composition(counts: DataFrame) -> DataFrame:
    """counts (instrument, source, n) as one map of counts by source for each instrument; it holds a source once."""
    return counts.groupBy("instrument").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("source_composition"))


def feature_vector(trades: DataFrame, quotes: DataFrame, asof: Column, include_outliers: bool = False, benchmark_30d: Column | None = None) -> DataFrame:
    """One row per instrument that traded or was quoted by asof.

    trades: id, at, instrument, price, outlier; quotes: id, at, instrument, low_price, listing_count. A window
    and an aggregate share one shuffle of the trades by instrument; only the last 30 days and the last
    12 trades are gathered into arrays, so that long histories stay sums."""
    keep = ~F.col("outlier") if not include_outliers else F.lit(True)
    order = W.partitionBy("instrument").orderBy(F.desc("at"), F.desc("id"))
    seen = trades.where(F.col("at") <= asof).withColumn("_keep", keep)
    seen = seen.withColumn("_rank", F.sum(F.col("_keep").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    ok, month = F.col("_keep"), trailing(F.col("at"), asof, 30)
    near = ok & (month | (F.col("_rank") <= 12))
    picks = []
    for p in PERIODS:
        slack = period_slack(p)
        picks += [newest(["id", "price"], ok & band(asof, 0, slack)).alias(f"_e{p}"), newest(["id", "price"], ok & band(asof, p, slack)).alias(f"_s{p}")]
    sold = seen.groupBy("instrument").agg(
        F.count_if(ok).alias("n"),
        *[c.alias(k) for k, c in velocity(F.col("at"), asof, ok).items()],
        F.median(F.when(ok & month, F.col("price"))).alias("rolling_median"),
        F.avg(F.when(ok & month, F.col("price"))).alias("_sma"),
        F.max(F.when(ok, F.col("price"))).alias("peak"),
        F.max(F.when(ok, F.col("at"))).alias("last_at"),
        F.max_by("outlier", F.struct("at", "id")).alias("outlier_driven"),
        F.array_sort(F.collect_list(F.when(near, F.struct("at", "id", "price")))).alias("_near"),
        *picks,
    )
    out = sold.join(supply(quotes, asof), "instrument", "full")
    price = lambda a: F.transform(a, lambda x: x["price"])
    recent = F.filter(F.coalesce("_near", F.array().cast("array<struct<at:bigint,id:bigint,price:double>>")), lambda x: x["at"] > asof - 30 * DAY)
    last12 = F.slice("_near", F.greatest(F.size("_near") - 11, F.lit(1)), F.lit(12))
    out = out.withColumns({"_month": price(recent), "_vol": price(F.when(F.size(recent) >= 3, recent).otherwise(last12)), "_all": price(F.col("_near"))})
    steps = lambda a: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.when(F.get(a, i - 1) > 0, F.get(a, i) / F.get(a, i - 1) - 1)), lambda r: r.isNotNull())
    gap = F.transform(F.sequence(F.lit(1), F.greatest(F.size(recent) - 1, F.lit(1))), lambda i: (F.get(recent, i)["at"] - F.get(recent, i - 1)["at"]) / 1000.0)
    change = F.col("listing_count") - F.col("listing_prev")
    last, second = F.get(F.col("_all"), F.size("_all") - 1), F.get(F.col("_all"), F.size("_all") - 2)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumns({c: zero(c) for c in ("n", "n1", "n7", "n30", "prior7")} | {"per_day": F.coalesce("per_day", F.lit(0.0))})
    out = out.withColumns({
        "sma": F.when(F.col("n30") >= 3, F.col("_sma")),
        "ema": ema(F.col("_month")),
        "median_intersale_ms": F.when(F.col("n30") >= 2, array_median(gap)),
        "volume_momentum": momentum_of_volume(),
        "listing_change": change,
        "listing_sale_ratio": F.when(F.col("n7") > 0, F.col("listing_count") / F.col("n7")),
        "absorption": F.when(F.col("listing_count") > 0, F.col("n7") / F.col("listing_count")),
        "last_price": last,
        "spread_change": (F.col("low_now") - last) - (F.col("low_prev") - second),
        "volatility": F.when(F.size("_vol") >= 2, array_mad(steps(F.col("_vol")))),
        "last_return": F.when(second > 0, last / second - 1),
        "drawdown": F.when(F.col("peak") > 0, (F.col("peak") - last) / F.col("peak")),
        "staleness_hours": (asof - F.col("last_at")) / 3.6e9,
        "outlier_driven": F.coalesce("outlier_driven", F.lit(False)),
    } | {f"ret_{p}d": _return(p) for p in PERIODS})
    ok_periods = sum((F.col(f"ret_{p}d").isNotNull().cast("int") for p in PERIODS), F.lit(0))
    momentum = F.coalesce("ret_30d", "ret_7d")
    out = out.withColumns({"ok_periods": ok_periods, "coverage": ok_periods / 6.0, "momentum": momentum})
    if benchmark_30d is not None:
        out = out.withColumn("relative_strength", F.col("momentum") - benchmark_30d)
    out = out.withColumns(_flags()).withColumns({"quality": quality_state(), "method_version": F.lit(METHOD)})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _return(p: int) -> Column:
    start, end = F.col(f"_s{p}"), F.col(f"_e{p}")
    return F.when(start.isNotNull() & end.isNotNull() & (start["id"] != end["id"]) & (start["price"] > 0), end["price"] / start["price"] - 1)


def _flags() -> dict[str, Column]:
    """Manipulation flags; a flag whose inputs are missing is false."""
    held = lambda c: F.coalesce(c, F.lit(False))
    thin = F.col("n7") <= 1
    spike = held((F.abs("last_return") > 0.25) & thin)
    jump = held((F.col("last_return") > 0.2) & thin)
    return {
        "thin_volume_spike": spike,
        "price_jump_without_volume": jump,
        "supply_disappearance": held((F.col("listing_change") < 0) & (F.abs("listing_change") >= 0.5 * F.col("listing_prev")) & (F.col("n7") == 0)),
        "price_volume_divergence": held((F.col("ret_7d") > 0.05) & (F.col("volume_momentum") < -0.2)),
        "breakout": held((F.col("ret_7d") > 0.1) & (F.col("n7") >= 3)) & ~spike & ~jump,
        "reversal": held((F.col("drawdown") > 0.2) & (F.coalesce("ret_7d", F.lit(0.0)) > 0) & (F.col("n7") >= 2)),
    }


def quality_state() -> Column:
    """outlier_dependent over stale over complete over partial over insufficient_data."""
    n = F.col("n")
    return ladder([(F.col("outlier_driven") & (n < 5), "outlier_dependent"), ((F.col("staleness_hours") > 720) & (n > 0), "stale"), ((n >= 8) & (F.col("ok_periods") >= 3), "complete"), (n >= 2, "partial")], "insufficient_data")
