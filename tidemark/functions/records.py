"""Record-level classification, fallbacks and validation rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import ladder

# Tokens of languages and variants, tried in this order.
LANGUAGE_TOKENS = (("simplified chinese", "zh-Hans"), ("traditional chinese", "zh-Hant"), ("zh-hans", "zh-Hans"), ("zh-hant", "zh-Hant"), ("japanese", "ja"), ("english", "en"), ("chinese", "zh-Hans"), ("jp", "ja"), ("ja", "ja"), ("en", "en"))
VARIANT_TOKENS = ((r"reverse[_\s-]?holo", "reverse_holo"), ("holofoil", "holofoil"), ("holo", "holofoil"), (r"alt[_\s-]?art", "alt_art"), (r"first[_\s-]?edition", "first_edition"), ("promo", "promo"), ("normal", "normal"))
# Formats of keys and of collector numbers.
EVENT_TYPE = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9_]*)+$"
METRIC_KEY = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9_]*)*$"
IDEMPOTENCY_KEY = r"^[A-Za-z0-9_.:-]+$"
COLLECTOR = r"(?i)\b((?:tg)?\d{1,3}/(?:tg)?\d{1,3}|\d{1,4}/\d{1,4}|p-\d{1,4}|\d{2,4})\b"
ENTITY_TYPES = ("company", "product", "person", "place", "topic", "instrument")
SUBSCRIPTION = ("trialing", "active", "past_due", "canceled", "incomplete", "unpaid", "paused")
PRESET_DAYS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90, "1y": 365}


#: Where a run of ASCII letters, digits and underscores begins or ends.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """The pattern with \\b between ASCII words and all else, accented letters included, as most engines have it; Java's takes those for word characters."""
    return pattern.replace(r"\b", EDGE)


def _first_token(text: Column, tokens: tuple[tuple[str, str], ...]) -> Column:
    return ladder([(text.rlike(ascii_edges(rf"(?i)\b{p}\b")), code) for p, code in tokens], None)


def language(text: Column) -> Column:
    return _first_token(text, LANGUAGE_TOKENS)


def variant(text: Column) -> Column:
    return _first_token(text, VARIANT_TOKENS)


def collector_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ascii_edges(COLLECTOR), 1), F.lit(""))


def explicit_or(explicit: Column, inferred: Column) -> Column:
    """The explicit value unless it is blank, else the inferred one."""
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), inferred)


def price_type(market_type: Column) -> Column:
    return ladder([(market_type == "marketplace_listing", "asking"), (market_type == "market_price", "reference"), (market_type.isin("marketplace_sold", "direct_sale"), "sold")], "reference")


def fact_kind(market_type: Column, price: Column, aggregation: Column) -> Column:
    return ladder([((market_type == "marketplace_sold") | (price == "sold"), "sold"), (market_type == "marketplace_listing", "listing"), (aggregation == "window", "volume")], "reference")


def sentiment(direction: Column, context: Column) -> tuple[Column, Column]:
    """(sentiment, confidence) from a direction, else from a mention's context."""
    name = ladder([(direction == "bullish", "positive"), (direction == "bearish", "negative"), (context.isin("pull", "identity"), "neutral")], "unknown")
    sure = ladder([(direction.isin("bullish", "bearish"), 0.4), (context.isin("pull", "identity"), 0.3)], None)
    return name, sure


def entity_type(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*ENTITY_TYPES), low).otherwise("generic")


def subscription_status(status: Column) -> Column:
    return F.when(status.isin(*SUBSCRIPTION), status).otherwise("incomplete")


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def url_path(*parts: Column) -> Column:
    """Percent-encoded parts under a slash each."""
    return F.concat(*[F.concat(F.lit("/"), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))) for p in parts])


def window_start(preset: Column, now: Column, depth_days: Column | None = None) -> Column:
    """Start (microseconds) of a preset window, no earlier than a plan's depth of history; unknown presets and all start at 0."""
    day = 86_400_000_000
    start = F.coalesce(*[F.when(preset == p, now - d * day) for p, d in PRESET_DAYS.items()], F.lit(0))
    return start if depth_days is None else F.greatest(start, now - depth_days * day)


def ingest_rules(event: Column, now: Column) -> list[tuple[str, Column]]:
    """Rules of an ingest body: event_type, occurred_at (microseconds), idempotency_key, metrics (key, value)."""
    key, metrics = event["idempotency_key"], event["metrics"]
    return [
        ("event_type", event["event_type"].rlike(EVENT_TYPE) & (F.length(event["event_type"]) <= 64)),
        ("idempotency_key", key.rlike(IDEMPOTENCY_KEY) & F.length(key).between(8, 128)),
        ("occurred_at", event["occurred_at"] <= now + 86_400_000_000),
        ("metrics_count", F.coalesce(F.size(metrics) <= 50, F.lit(True))),
        ("metric_key", F.coalesce(F.forall(metrics, lambda m: m["key"].rlike(METRIC_KEY) & (F.length(m["key"]) <= 64)), F.lit(True))),
        ("metric_value", F.coalesce(F.forall(metrics, lambda m: m["value"].isNotNull() & ~F.isnan(m["value"])), F.lit(True))),
    ]


def content_rules(url: Column, excerpt: Column, retention: Column, confidence: Column) -> list[tuple[str, Column]]:
    return [
        ("canonical_url", url.rlike("(?i)^https?://")),
        ("retention", ~((retention == "reference_only") & excerpt.isNotNull())),
        ("excerpt", excerpt.isNull() | (F.length(excerpt) <= 500)),
        ("confidence", confidence.isNull() | confidence.between(0, 1)),
    ]


def alert_rules(kind: Column, value: Column) -> list[tuple[str, Column]]:
    return [
        ("threshold", (kind != "threshold") | value.between(0, 100)),
        ("percent", (kind != "percent") | (value > 0)),
        ("usage", (kind != "usage") | value.isin(50, 80, 90, 100)),
        ("kind", kind.isin("threshold", "percent", "usage")),
    ]
