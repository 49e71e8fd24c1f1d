"""Explainable weighted scores: parts that may be missing, renormalised weights, a recommendation ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.stats import clamp, ladder

# Weights and thresholds of score.v1 and recommendation.v1.
OPPORTUNITY_WEIGHTS = {"price_momentum": 0.22, "volume_momentum": 0.18, "sales_velocity": 0.12, "relative_strength": 0.16, "supply_absorption": 0.14, "creator_consensus": 0.12, "social_momentum": 0.06}
RISK_WEIGHTS = {"volatility": 0.2, "thin_liquidity": 0.16, "spread": 0.1, "low_sample": 0.14, "outlier_dependence": 0.1, "social_unconfirmed": 0.12, "supply_shock": 0.1, "creator_disagreement": 0.08}
CONFIDENCE_WEIGHTS = {"market_sample": 0.28, "source_coverage": 0.12, "freshness": 0.18, "resolution_certainty": 0.14, "creator_reliability": 0.14, "cross_source": 0.14}
LIQUIDITY_WEIGHTS = {"sales_frequency": 0.28, "intersale_time": 0.18, "listing_depth": 0.16, "spread": 0.14, "seller_diversity": 0.12, "historical_sales": 0.12}
SOCIAL_CAP = 55.0


def signed(x: Column, scale: float) -> Column:
    return clamp(50 + x / scale * 50)


def positive(x: Column, good: float) -> Column:
    return clamp(x / good * 100)


def inverse(x: Column, bad: float) -> Column:
    return clamp(100 - x / bad * 100)


def parts(weights: dict[str, float], scores: dict[str, Column]) -> Column:
    """Array of (key, score, weight); a part that is missing has a null score."""
    return F.array(*[F.struct(F.lit(k).alias("key"), scores[k].cast("double").alias("score"), F.lit(w).alias("weight")) for k, w in weights.items()])


def _weight_there(part: Column) -> Column:
    """Sum of the weights whose scores are there, exact to 12 decimals: a sum of doubles can push a score past a threshold it only reaches."""
    exact = "decimal(24,12)"
    there = F.filter(part, lambda p: p["score"].isNotNull())
    return F.aggregate(there, F.lit(0).cast(exact), lambda a, p: (a + p["weight"].cast(exact)).cast(exact)).cast("double")


def combine(part: Column) -> Column:
    """Weighted mean of the scores that are there, 50 where none is, within 0 to 100."""
    there, w = F.filter(part, lambda p: p["score"].isNotNull()), _weight_there(part)
    return F.when(w > 0, clamp(F.aggregate(there, F.lit(0.0), lambda a, p: a + p["weight"] * p["score"]) / w)).otherwise(50.0)


def explain(part: Column) -> Column:
    """parts with the weight each had in the end, its contribution, and why a part was left out."""
    w = _weight_there(part)
    return F.transform(part, lambda p: F.struct(p["key"].alias("key"), p["score"].alias("score"), F.when(p["score"].isNotNull(), p["weight"] / w).otherwise(0.0).alias("applied_weight"), F.coalesce(p["score"] * p["weight"] / w, F.lit(0.0)).alias("contribution"), F.when(p["score"].isNull(), "missing_input").alias("skipped_reason")))


def consensus(direction: Column, weight: Column) -> dict[str, Column]:
    """Aggregates over votes: total weight, mean sign, disagreement (mean absolute distance from the mean sign).

    With signs -1, 0 and 1 the disagreement follows from the weights of each, so one pass is enough."""
    sign = F.when(direction == "bullish", 1.0).when(direction == "bearish", -1.0).otherwise(0.0)
    total = F.sum(weight)
    up, down = F.sum(F.when(sign > 0, weight).otherwise(0.0)), F.sum(F.when(sign < 0, weight).otherwise(0.0))
    mean = (up - down) / F.nullif(total, F.lit(0.0))
    spread = (up * F.abs(1 - mean) + down * F.abs(-1 - mean) + (total - up - down) * F.abs(mean)) / F.nullif(total, F.lit(0.0))
    enough = total >= 0.05
    return {"total_weight": total, "consensus": F.when(enough, mean), "disagreement": F.when(enough, spread)}


def social_score(m7: Column, p7: Column, contents: Column, accounts: Column, engagement: Column) -> Column:
    """Momentum of mentions, breadth and engagement; null where nothing was said."""
    accel = F.when(p7 >= 2, m7 / p7 - 1).when(m7 >= 3, 1.0).otherwise(0.0)
    score = 40 + 30 * clamp(accel, -1.0, 2.0) + 20 * F.least(F.lit(1.0), accounts / 8 + contents / 8) + 10 * F.least(F.lit(1.0), engagement / 50000)
    return F.when((m7 > 0) | (contents > 0), clamp(score))


def recommend(opportunity: Column, risk: Column, confidence: Column, liquidity: Column, n: Column, quality: Column, confirmed: Column, hype: Column) -> Column:
    """The label of the first rule that holds; none does where nothing else is left but to watch."""
    sound = confirmed & ~hype
    over = lambda o, r, c, q: sound & (opportunity >= o) & (risk <= r) & (confidence >= c) & (liquidity >= q)
    return ladder(
        [
            ((n < 3) | (quality == "insufficient_data") | (confidence < 25), "insufficient_data"),
            (~sound & (opportunity >= 50) & (risk <= 65), "watch"),
            (over(75, 40, 60, 55), "strong_buy"),
            (over(60, 50, 50, 45), "buy"),
            ((opportunity >= 50) & (risk <= 65), "watch"),
            ((opportunity <= 30) & (risk >= 80), "strong_sell"),
            ((opportunity <= 35) & (risk >= 65), "sell"),
            ((opportunity <= 40) & (risk >= 55), "reduce"),
            (opportunity >= 40, "hold"),
        ],
        "watch",
    )


def score_columns() -> dict[str, Column]:
    """Opportunity, risk, confidence, liquidity and recommendation over a feature vector.

    Besides the features it reads relative_strength, spread_ratio, consensus, disagreement, total_weight,
    social and sources (how many kinds of source were seen). Momentum falls back from 30 to 7 days where
    the former is insufficient. There are no sellers in quotes, so that part is always missing."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    confirmed = zero("n7") >= 3
    hype = F.coalesce(c("social") >= 65, F.lit(False)) & ~confirmed
    shock = c("supply_disappearance") | F.coalesce((c("listing_change") < 0) & (c("n7") == 0), F.lit(False))
    fixed = lambda x: F.lit(float(x))
    opportunity = combine(parts(OPPORTUNITY_WEIGHTS, {"price_momentum": signed(c("momentum"), 0.2), "volume_momentum": signed(c("volume_momentum"), 1), "sales_velocity": positive(c("per_day"), 1), "relative_strength": signed(c("relative_strength"), 0.15), "supply_absorption": positive(c("absorption"), 1), "creator_consensus": signed(c("consensus"), 1), "social_momentum": c("social")}))
    risk = combine(parts(RISK_WEIGHTS, {"volatility": positive(c("volatility"), 0.15), "thin_liquidity": inverse(c("n7"), 10), "spread": clamp((c("spread_ratio") - 1) * 200), "low_sample": inverse(c("n"), 20), "outlier_dependence": F.when(c("outlier_driven") | (c("quality") == "outlier_dependent"), 80.0).otherwise(15.0), "social_unconfirmed": F.when(hype, 85.0).when(c("thin_volume_spike"), 70.0), "supply_shock": F.when(shock, 75.0), "creator_disagreement": clamp(c("disagreement") * 100)}))
    confidence = combine(parts(CONFIDENCE_WEIGHTS, {"market_sample": clamp(c("n") / 12 * 100), "source_coverage": clamp(c("sources") * 40.0), "freshness": inverse(c("staleness_hours"), 504), "resolution_certainty": fixed(100), "creator_reliability": F.when(c("consensus").isNotNull(), clamp(c("total_weight") * 200)), "cross_source": F.when(c("sources") >= 2, 80.0).otherwise(35.0)}))
    liquidity = combine(parts(LIQUIDITY_WEIGHTS, {"sales_frequency": clamp(c("n7") / 8 * 100), "intersale_time": inverse(c("median_intersale_ms") / 86_400_000, 14), "listing_depth": positive(c("listing_count"), 20), "spread": inverse(F.when(c("spread_ratio").isNotNull(), F.greatest(fixed(0), c("spread_ratio") - 1)), 0.35), "seller_diversity": F.lit(None), "historical_sales": clamp(c("n30") / 20 * 100)}))
    capped = F.when(hype, F.least(opportunity, F.lit(SOCIAL_CAP))).otherwise(opportunity)
    return {"opportunity": capped, "risk": risk, "confidence": confidence, "liquidity": liquidity, "recommendation": recommend(capped, risk, confidence, liquidity, c("n"), c("quality"), confirmed, hype)}
