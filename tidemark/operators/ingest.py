"""Record validation, deduplication with conflicts, projections of facts to metrics and kernel rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import stable_id

# Catalogs of market records.
CURRENCIES = ("USD", "JPY", "EUR", "GBP", "CAD", "AUD", "CHF", "CNY", "KRW", "SGD", "HKD", "TWD")
CONDITIONS = ("nm", "lp", "mp", "hp", "dmg", "unknown")
SECRET = r"(?i)(sk_live|whsec_|bearer\s+[a-z0-9]|password|api[_-]?key)"


def first_failure(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that fails; a rule whose inputs are missing fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])


def failures(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all rules that fail."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))


def market_rules(price: Column, currency: Column, condition: Column, quantity: Column, at: Column, now: Column) -> list[tuple[str, Column]]:
    return [
        ("currency", currency.isin(*CURRENCIES)),
        ("condition", condition.isin(*CONDITIONS)),
        ("price", price.isNull() | (price > 0)),
        ("quantity", quantity.isNull() | (quantity >= 0)),
        ("observed_at", at <= now),
    ]


def redact(text: Column, pattern: str = SECRET) -> Column:
    """Every secret-like passage replaced."""
    return F.regexp_replace(text, pattern, "[redacted]")


def _counted(rows: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Equal rows once, with _copies and _key, dealt out by their key, so that what follows by _key shuffles nothing more.

    _key holds nulls as values: a null is a key like any other."""
    held = rows.withColumn("_key", F.struct(*[F.col(k) for k in key])).repartition("_key")
    return held.groupBy("_key", *columns).agg(F.count("*").alias("_copies"))


def _each(rows: DataFrame, name: str, first: Column, others: Column) -> DataFrame:
    """rows as often as _copies says, with a column name that is first for the first copy and others for the rest."""
    every = F.concat(F.array(first), F.array_repeat(others, (F.col("_copies") - 1).cast("int")))
    return rows.withColumn(name, F.explode(every)).drop("_copies")


def dedup_conflicts(rows: DataFrame, key: Sequence[str], fingerprint: str, order: Sequence[str]) -> DataFrame:
    """rows with verdict: new (the first of its key to arrive), duplicate (same fingerprint as the first) or conflict.

    order is the order of arrival, ties by the fingerprint. Of rows equal in everything one is new and the others are
    duplicates. A null is a key like any other. The first row of a key is a grouped minimum, joined back."""
    counted = _counted(rows, rows.columns, key)
    own = F.struct(*order, fingerprint)
    met = counted.join(counted.groupBy("_key").agg(F.min(own).alias("_first")), "_key")
    is_first = own.eqNullSafe(F.col("_first"))
    same = F.when(F.col(fingerprint).eqNullSafe(F.col("_first")[fingerprint]), "duplicate").otherwise("conflict")
    return _each(met, "verdict", F.when(is_first, "new").otherwise(same), same).select(*rows.columns, "verdict")


def record_states(records: DataFrame, catalog: DataFrame, key: Sequence[str], fingerprint: str, order: Sequence[str], attributes: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """records with state, reason and target, as a provider's feed is taken in.

    A record that names no external id and lacks one of the needed attributes (concept_only), or meets no entry
    (not_found) or several (ambiguous) of the catalog, is quarantined until one of its key has been processed. The
    first that can be is processed, with its target; of those that arrive after it, ones with its fingerprint are
    duplicates and all others revisions, which are never applied. order is the order of arrival, ties by the fingerprint; of rows
    equal in everything one at most is processed. A null is a key like any other.
    catalog has target, external and the attributes, and is counted by them first, so that no record meets many entries."""
    named = catalog.groupBy("external").agg(F.count("*").alias("_n_named"), F.min("target").alias("_named"))
    alike = catalog.groupBy(*attributes).agg(F.count("*").alias("_n_alike"), F.min("target").alias("_alike"))
    met = records.join(named, "external", "left").join(alike, list(attributes), "left")
    has_id = F.col("external").isNotNull()
    n = F.coalesce(F.when(has_id, F.col("_n_named")).otherwise(F.col("_n_alike")), F.lit(0))
    lacking = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in needed])
    reason = F.when(~has_id & lacking, "concept_only").when(n == 0, "not_found").when(n > 1, "ambiguous")
    met = met.select(*records.columns, reason.alias("_reason"), F.when(has_id, F.col("_named")).otherwise(F.col("_alike")).alias("_met"))
    own = F.struct(*order, fingerprint)
    met = _counted(met, met.columns, key)
    met = met.join(met.groupBy("_key").agg(F.min(F.when(F.col("_reason").isNull(), own)).alias("_first")), "_key")
    early = F.col("_first").isNull() | (own < F.col("_first"))
    later = F.when(F.col(fingerprint).eqNullSafe(F.col("_first")[fingerprint]), "duplicate").otherwise("revision")
    later = F.when(early, "quarantined").otherwise(later)
    stated = _each(met, "state", F.when(own.eqNullSafe(F.col("_first")), "processed").otherwise(later), later)
    return stated.select(*records.columns, "state", F.when(F.col("state") == "quarantined", F.col("_reason")).alias("reason"), F.when(F.col("state") == "processed", F.col("_met")).alias("target"))


def unpivot_metrics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[tuple[str, Column, str, Column]]) -> DataFrame:
    """0 to n rows (keys, metric_key, value, unit) of each row: those metrics whose condition holds and whose value is there."""
    each = F.array(*[F.when(when & value.isNotNull(), F.struct(F.lit(name).alias("metric_key"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))) for name, value, unit, when in metrics])
    return rows.select(*keys, F.explode(F.array_compact(each)).alias("m")).select(*keys, "m.*")


def kernel_rows(events: DataFrame) -> dict[str, DataFrame]:
    """An event's rows in each kernel table, with ids that follow from the event, so that a replay gives the same rows.

    events: organization, event_id, event_type, at, entity, value."""
    ids = events.withColumns({"entity_id": stable_id("ent_", F.col("organization"), F.col("entity")), "observation_id": stable_id("obs_", F.col("organization"), F.col("event_id"))})
    return {
        "entity": ids.select("organization", "entity_id", "entity").distinct(),
        "observation": ids.select("organization", "observation_id", "entity_id", "event_type", "at"),
        "metric": ids.where("value is not null").select("organization", "observation_id", stable_id("met_", F.col("observation_id"), F.lit("value")).alias("metric_id"), F.lit("value").alias("metric_key"), "value"),
        "evidence": ids.select("organization", stable_id("evi_", F.col("observation_id")).alias("evidence_id"), "observation_id"),
        "signal": ids.select("organization", stable_id("sig_", F.col("entity_id"), F.col("observation_id")).alias("signal_id"), "entity_id", "observation_id"),
    }


def exploded(content: DataFrame, items: str, prefix: str, keys: Sequence[str]) -> DataFrame:
    """One row per entry of an array column with its ordinal and an id that follows from the keys and the ordinal."""
    rows = content.select(*keys, F.posexplode(items).alias("ordinal", "item"))
    return rows.withColumn("item_id", stable_id(prefix, *[F.col(k) for k in keys], F.col("ordinal")))
