"""Registry of named queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Instants at which the event and line-item queries stand.
ASOF = "2024-01-30 00:00:00"
LONG_ASOF = "2000-06-30 00:00:00"

#: Common table expressions of the oracle's side.
TRADES = "t AS (SELECT event_id AS id, ts, user_id AS instrument, value AS price FROM events WHERE event_type = 'purchase')"
QUOTES = "q AS (SELECT event_id AS id, ts, user_id AS instrument, value AS low_price, (props->>'$.k')::BIGINT AS listing_count FROM events WHERE event_type = 'view')"
DAILY = "l AS (SELECT l_partkey AS instrument, l_shipdate AS ts, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS quantity, count(*) AS sales FROM lineitem GROUP BY ALL)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle's SQL if SQL can say it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep
