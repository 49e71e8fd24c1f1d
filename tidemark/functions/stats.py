"""Small-sample statistics and bucketing ladders as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(x: Column, y: Column) -> Column:
    """x / y of doubles as IEEE has it, and SQL's engines outside ANSI: infinite over 0, and NaN for 0 over 0."""
    return F.when(y == 0, x * float("inf")).otherwise(x / F.nullif(y, F.lit(0.0)))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x held between two bounds; null stays null (greatest and least skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0.0))


def half_up(x: Column) -> Column:
    """The nearest whole number, halves upward: floor(x + 0.5)."""
    return F.floor(x + 0.5)


def wilson_low(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of Wilson's interval for k of n; 0 for no observations."""
    return _wilson(k, n, z, -1)


def wilson_high(k: Column, n: Column, z: float = 1.96) -> Column:
    """Upper bound of Wilson's interval for k of n; 1 for no observations."""
    return _wilson(k, n, z, 1)


def _wilson(k: Column, n: Column, z: float, sign: int) -> Column:
    p = k / F.nullif(n.cast("double"), F.lit(0.0))
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    bound = (p + z * z / (2.0 * n) + sign * spread) / (1 + z * z / n.cast("double"))
    return F.when(n > 0, F.greatest(F.least(bound, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0 if sign < 0 else 1.0))


def beta_mean(k: Column, n: Column, a: float = 8.0, b: float = 8.0) -> Column:
    return (k + a) / (n + a + b)


def shrink(n: Column, prior: float = 20.0) -> Column:
    return n / (n + prior)


def half_life(age_days: Column, days: float = 180.0) -> Column:
    return F.pow(F.lit(0.5), age_days / days)


def ladder(steps: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first step that holds."""
    (first, value), *rest = steps
    chain = reduce(lambda acc, s: acc.when(s[0], s[1]), rest, F.when(first, value))
    return chain.otherwise(otherwise)


def price_tier(price: Column) -> Column:
    return ladder([(price.isNull(), "unknown"), (price < 25, "lt_25"), (price < 100, "25_100"), (price < 500, "100_500")], "gte_500")


def trust_state(n: Column, low: Column, excluded: Column | None = None) -> Column:
    """Trust from the sample's size and the Wilson bound; exclusion wins."""
    steps = [(n < 5, "low_confidence"), ((low < 0.35) & (n >= 8), "unreliable"), (n < 20, "developing"), ((n >= 50) & (low >= 0.62), "trusted"), (low >= 0.5, "reliable")]
    if excluded is not None:
        steps.insert(0, (excluded, "excluded"))
    return ladder(steps, "developing")


def authority_score(n: Column, low: Column, mean_return: Column) -> Column:
    pull = F.coalesce(clamp(mean_return, -0.5, 0.5), F.lit(0.0))
    return clamp(100 * (0.85 * low + 0.15 * (0.5 + pull)) * shrink(n))


def authority_weight(n: Column, low: Column, state: Column) -> Column:
    trust = ladder([(state == "trusted", 1.0), (state == "reliable", 0.8), (state == "developing", 0.45)], 0.2)
    return F.when(state == "excluded", 0.0).when(state == "unreliable", 0.05 * shrink(n)).otherwise(F.round(shrink(n) * trust * F.greatest(low, F.lit(0.0)), 6))
