"""Stateful streams: outlier flags in order of arrival, with the newest prices of each key as state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import HIGH, LOW

# Of an outlier rule.
EXTREME_QUANTITY = 1000
PRIOR, LEAST = 7, 3
FLAGS = "id long, median_before double, outlier boolean, reason string"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def flagged(price: float | None, quantity: float | None, before: list[float]) -> tuple[float | None, bool, str | None]:
    """median_before, outlier and reason of a record, given the prices known before it."""
    middle = median(before) if len(before) >= LEAST else None
    if quantity is not None and quantity > EXTREME_QUANTITY:
        return middle, True, "extreme_quantity"
    if price is None or middle is None or middle <= 0:
        return middle, False, None
    if price > middle * HIGH or price < middle * LOW:
        return middle, True, "outside_rolling_median"
    return middle, False, None


def _number(x: object) -> float | None:
    return None if pd.isna(x) else float(x)


def _newest(known: list[tuple], more: list[tuple]) -> list[tuple]:
    """The PRIOR newest of records (at, id, price) by their own time."""
    return sorted([*known, *more], key=lambda x: x[:2], reverse=True)[:PRIOR]


class OutlierFlags(StatefulProcessor):
    """Flags each record of a key by the PRIOR records newest by their own time among those that arrived before it.

    State of a key: those records, PRIOR at most, and the flags given to records of the last keep_us before the newest, so
    that a replay gets the same flag and isn't counted again. Older flags are forgotten; state doesn't grow otherwise."""

    def __init__(self, keep_us: int) -> None:
        self._keep = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getListState("newest", "at long, id long, price double")
        self._given = handle.getListState("given", "at long, id long, median_before double, outlier boolean, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        newest = [tuple(x) for x in self._newest.get()] if self._newest.exists() else []
        given = {x[1]: tuple(x) for x in self._given.get()} if self._given.exists() else {}
        out, together, last = [], [], None
        for seq, at, i, price, quantity in zip(arrived["seq"], arrived["at"], arrived["id"], arrived["price"], arrived["quantity"], strict=True):
            at, i, price = int(at), int(i), _number(price)
            if seq != last:  # those of one seq arrive at once: none is before another
                newest, together, last = _newest(newest, together), [], seq
            if i not in given:
                given[i] = (at, i, *flagged(price, _number(quantity), [p for _, _, p in newest if not pd.isna(p)]))
                together = _newest(together, [(at, i, price)])
            out.append((i, *given[i][2:]))
        newest = _newest(newest, together)
        self._newest.put(newest)
        self._given.put([x for x in given.values() if x[0] >= newest[0][0] - self._keep])
        yield pd.DataFrame(out, columns=["id", "median_before", "outlier", "reason"]).astype({"median_before": "float64", "outlier": "bool"})

    def close(self) -> None:
        """Nothing is held outside the state."""


def outlier_flags(records: DataFrame, key: str, keep_days: int = 7) -> DataFrame:
    """id, median_before, outlier and reason of each record of a stream, in order of arrival.

    records: key, seq (order of arrival within a batch; records of one seq arrive at once), id, at (microseconds of the record's own time), price and
    quantity, both nullable. A key's records of one batch are sorted together, so a batch's files bound what one task holds;
    across batches its state of a few prices, and of the flags of keep_days, goes on. Run it with state_in_rocksdb."""
    rows = records.select(key, "seq", "id", "at", "price", "quantity")
    return rows.groupBy(key).transformWithStateInPandas(OutlierFlags(keep_days * 86_400_000_000), FLAGS, "Append", "None")
