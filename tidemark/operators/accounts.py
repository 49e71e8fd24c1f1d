"""Tenant operations: lifecycle, activation, health, segments, entitlements, warnings, retries, preferences, content gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import clamp, half_up, ladder

# The customer lifecycle's edges.
LIFECYCLE = {
    "lead": ("signup",),
    "signup": ("onboarding", "trial"),
    "onboarding": ("activated", "trial", "canceled"),
    "activated": ("trial", "customer", "at_risk", "canceled"),
    "trial": ("customer", "activated", "at_risk", "past_due", "canceled"),
    "customer": ("at_risk", "past_due", "canceled"),
    "at_risk": ("customer", "trial", "past_due", "canceled"),
    "past_due": ("customer", "trial", "canceled", "churned"),
    "canceled": ("churned", "customer", "trial"),
    "churned": ("customer", "trial"),
}
# Monthly requests, history depth in days and predictions of each plan.
PLANS = [("free", 1000, 30, False), ("starter", 25000, 90, True), ("growth", 150000, 365, True), ("scale", 1000000, 1825, True)]
THRESHOLDS = (50, 80, 90, 100)
CATEGORIES = ("account", "billing", "usage", "security", "product", "marketing")
CHANNELS = ("email", "in_app", "webhook")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in LIFECYCLE.items() for b in to], "src string, dst string")


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, requests long, depth_days int, predictions boolean")


def segment(rules: list[tuple[str, str, object]]) -> Column:
    """A predicate of (field, eq or neq, value) rules that must all hold; a null field counts as empty text. An
    unknown operator or an empty list matches nothing."""
    if not rules or any(op not in ("eq", "neq") for _, op, _ in rules):
        return F.lit(False)

    def one(field: str, op: str, value: object) -> Column:
        same = F.coalesce(F.col(field).cast("string"), F.lit("")) == F.lit(str(value))
        return same if op == "eq" else ~same

    return reduce(lambda a, b: a & b, [one(*r) for r in rules])


def activation(events: DataFrame, key: str, created: Column, first_uses: dict[str, Column]) -> DataFrame:
    """(key, created, each first use, activated): created and any first use."""
    found = events.groupBy(key).agg(F.bool_or(created).alias("created"), *[F.bool_or(c).alias(n) for n, c in first_uses.items()])
    return found.withColumn("activated", F.col("created") & reduce(lambda a, b: a | b, [F.col(n) for n in first_uses]))


def suggested_stage(stage: Column, billing: Column, plan: Column, activated: Column, at_risk: Column) -> Column:
    """The lifecycle stage that billing, activation and risk point to; the current one where nothing does."""
    paying = billing.isin("active", "trialing")
    steps = [
        ((billing == "canceled") & (stage == "churned"), F.lit("churned")), (billing == "canceled", F.lit("canceled")), (billing.isin("past_due", "unpaid"), F.lit("past_due")), (at_risk & paying, F.lit("at_risk")),
        ((billing == "active") & (plan != "free"), F.lit("customer")), (billing == "trialing", F.lit("trial")), (activated, F.lit("activated")), (stage == "lead", F.lit("signup")), (stage == "signup", F.lit("onboarding")),
    ]
    return ladder(steps, stage)


def health(activated: Column, created: Column, recent: Column, usage: Column, limit: Column, payment_failed: Column, endpoints: Column, failing: Column, billing: Column, adopted: Column) -> dict[str, Column]:
    """Seven component scores from 0 to 100 and overall, their mean, rounded half up.

    recent counts events of 14 days, failing the endpoints with failures or disabled, adopted the features used, of four."""
    share = usage / F.nullif(limit.cast("double"), F.lit(0.0))
    parts = {
        "activation": F.when(activated, 100).when(created, 40).otherwise(0),
        "recent_activity": F.when(recent == 0, 20).otherwise(F.least(F.lit(100), 40 + recent * 15)),
        "api_usage": F.when(F.coalesce(limit, F.lit(0)) <= 0, F.when(usage > 0, 70).otherwise(30)).when(usage == 0, 25).when(share >= 1, 55).otherwise(clamp(half_up(40 + 60 * share))),
        "errors": F.when(payment_failed, 35).otherwise(80),
        "webhook_health": F.when(endpoints == 0, 60).when(failing == 0, 100).otherwise(F.greatest(F.lit(0), 100 - failing * 25)),
        "billing_health": F.when(billing.isin("active", "trialing"), 100).when(billing == "past_due", 30).when(billing == "canceled", 10).otherwise(50),
        "feature_adoption": F.least(F.lit(100), adopted * 25),
    }
    parts = {k: c.cast("int") for k, c in parts.items()}
    return parts | {"overall": half_up(sum((p.cast("double") for p in parts.values()), F.lit(0.0)) / len(parts)).cast("int")}


def entitled(rows: DataFrame, plan_table: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows (organization, plan, status) with requests: the override if there is one, else the effective plan's.

    Unpaid or unknown plans are free. plan_table has a row per plan; overrides (organization, requests) may be large."""
    known = [p for p, *_ in PLANS]
    effective = F.when(F.col("status").isin("active", "trialing") & F.col("plan").isin(*known), F.col("plan")).otherwise("free")
    joined = rows.withColumn("effective_plan", effective).join(F.broadcast(plan_table.select(F.col("plan").alias("effective_plan"), F.col("requests").alias("_plan"), "depth_days")), "effective_plan")
    joined = joined.join(overrides.select("organization", F.col("requests").alias("_own")), "organization", "left")
    return joined.withColumn("requests", F.coalesce("_own", "_plan")).drop("_own", "_plan")


def used_units(rows: DataFrame, key: str, amount: str, unit: int = 100) -> DataFrame:
    """key and used: whole units in the sum of each key's amounts, which is rounded to a whole number (halves up) before.

    Amounts are added as decimals of 6 places: a sum of doubles hangs on the order of rows, and 99.50 may then fall short of 100."""
    total = F.round(F.sum(F.col(amount).cast("decimal(28,6)")))
    return rows.groupBy(key).agg(F.floor(total / unit).cast("long").alias("used"))


def quota(used: Column, limit: Column) -> dict[str, Column]:
    return {"exceeded": used >= limit, "remaining": F.greatest(limit - used, F.lit(0))}


def warnings_due(usage: DataFrame, emitted: DataFrame) -> DataFrame:
    """(organization, month, threshold, severity) of thresholds crossed and not yet emitted. usage: organization, month, used, limit."""
    steps = F.explode(F.array(*[F.lit(t) for t in THRESHOLDS]))
    crossed = usage.withColumn("threshold", steps).where((F.col("limit") > 0) & (100 * F.col("used") >= F.col("threshold") * F.col("limit")))
    due = crossed.join(emitted, ["organization", "month", "threshold"], "left_anti")
    return due.select("organization", "month", "threshold", F.when(F.col("threshold") >= 100, "critical").when(F.col("threshold") >= 90, "warning").otherwise("info").alias("severity"))


def retry(attempt: Column, http: Column, streak: Column) -> dict[str, Column]:
    """Next state of a delivery attempt: status, delay in seconds of the next try, and whether the endpoint is disabled."""
    done = http.between(200, 299)
    permanent = http.between(400, 499) & ~http.isin(408, 429)
    dead = ~done & (permanent | (attempt >= 8))
    status = F.when(done, "delivered").when(dead, "dead").otherwise("pending")
    return {"status": status, "delay_s": F.when(~done & ~dead, F.least(60 * F.pow(F.lit(2.0), attempt - 1), F.lit(86400.0)).cast("long")), "disabled": streak >= 8}


def default_opt_in(category: Column, channel: Column) -> Column:
    """Marketing is off; account, security, billing and usage reach email and the app; others the app alone."""
    broad = category.isin("account", "security", "billing", "usage")
    return F.when(category == "marketing", False).when(broad, channel.isin("email", "in_app")).otherwise(channel == "in_app")


def preferences(users: DataFrame, stored: DataFrame) -> DataFrame:
    """Each user's opt-in for every category and channel: stored (user, category, channel, opted_in) over the default.

    Account and security always reach email and the app."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(h).alias("channel")) for c in CATEGORIES for h in CHANNELS])
    every = users.select("user", F.explode(pairs).alias("p")).select("user", "p.*")
    joined = every.join(stored, ["user", "category", "channel"], "left")
    required = F.col("category").isin("account", "security") & (F.col("channel") != "webhook")
    return joined.withColumn("opted_in", F.when(required, True).otherwise(F.coalesce("opted_in", default_opt_in(F.col("category"), F.col("channel")))))


def thin_evidence(has_identity: Column, has_snapshot: Column, has_score: Column, recommendation: Column, sources: Column, signals: Column, falsifiers: Column, min_sources: int, min_signals: int) -> Column:
    """Whether evidence is too thin to publish on."""
    return ~has_identity | ~(has_snapshot | has_score) | (recommendation == "insufficient_data") | (sources < min_sources) | (signals < min_signals) | (falsifiers == 0)


def invite(found: Column, expires: Column, uses: Column, most: Column, same_email: Column, now: Column) -> Column:
    """Outcome of using an invitation: the first obstacle, else accepted."""
    return F.when(~found, "invalid").when(expires <= now, "expired").when(uses >= most, "exhausted").when(~same_email, "email_mismatch").otherwise("accepted")
