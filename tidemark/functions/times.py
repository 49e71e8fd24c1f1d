"""Instants as microseconds since the epoch, so that windows are plain integer ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without zone, the latter read in the session's zone."""
    return F.unix_micros(ts.cast("timestamp"))


def instant(text: str) -> Column:
    """Microseconds of an instant written as text, read in the session's zone."""
    return micros(F.lit(text))


def trailing(at: Column, asof: Column, days: float, lag_days: float = 0) -> Column:
    """Half-open window (asof - lag - days, asof - lag]."""
    end = asof - int(lag_days * DAY)
    return (at > end - int(days * DAY)) & (at <= end)
