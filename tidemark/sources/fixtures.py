"""Providers of records and of billing events as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import UNSET, conjunction

def market_records(records: DataFrame, provider: object = UNSET, language: object = UNSET, kind: object = UNSET) -> DataFrame:
    """The records (with provider, language, kind) that one asks a provider for; what isn't given is free, and the conditions reach the scan."""
    return records.where(conjunction(provider=provider, language=language, kind=kind))


def subscriptions(events: DataFrame) -> DataFrame:
    """Billing events (event_id, organization, at, status, plan) as the newest subscription of each organisation.

    An event delivered twice counts once."""
    once = events.groupBy("event_id").agg(F.min(F.struct("at", "organization", "status", "plan")).alias("e"))
    newest = once.select("event_id", "e.*").groupBy("organization").agg(F.max_by(F.struct("status", "plan"), F.struct("at", "event_id")).alias("s"))
    return newest.select("organization", "s.*")
