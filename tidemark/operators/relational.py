"""Relational building blocks: filters, keyset pages, upserts, interval rewrites, set operations, routing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNSET = object()


def conjunction(**conditions: object) -> Column:
    """Equality on each column given; UNSET leaves a column free, None asks for null, a list for membership."""
    parts = []
    for name, wanted in conditions.items():
        if wanted is UNSET:
            continue
        c = F.col(name)
        parts.append(c.isNull() if wanted is None else c.isin(*wanted) if isinstance(wanted, (list, tuple, set)) else c == wanted)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def for_tenant(df: DataFrame, tenant: object, column: str = "organization") -> DataFrame:
    """Only the tenant's rows; without a tenant it refuses, so that nothing leaks."""
    if tenant is None or tenant == "":
        raise ValueError("a tenant is needed")
    return df.where(F.col(column) == F.lit(tenant))


def keyset_page(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """The page of up to size rows behind a key, in its order, with has_more on each."""
    size = max(1, min(int(size), 100))
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    top = rows.orderBy(key).limit(size + 1)
    order = W.orderBy(key)  # size + 1 rows
    numbered = top.withColumn("_n", F.row_number().over(order)).withColumn("has_more", F.count("*").over(W.partitionBy()) > size)
    return numbered.where(F.col("_n") <= size).drop("_n")


def top_k(df: DataFrame, order: Sequence[Column], k: int | None, default: int = 50, most: int = 200) -> DataFrame:
    return df.orderBy(*order).limit(max(0, min(default if k is None else k, most)))


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole newest row of each key: one grouped max_by, combined before the shuffle."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return newest.select("_r.*")


def insert_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of new whose key isn't there yet, the first of each key."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return first.join(existing.select(*keys), list(keys), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """existing with new's rows in place of those of equal key, the last by order of each."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by_key(both, keys, ["_new", order]).drop("_new")


def close_intervals(current: DataFrame, leaving: DataFrame, keys: Sequence[str], at: Column, end: str = "effective_to") -> DataFrame:
    """current with open intervals of the keys that leave closed at an instant; closed ones stay as they are."""
    marked = current.join(leaving.select(*keys).distinct().withColumn("_gone", F.lit(True)), list(keys), "left")
    closed = F.when(F.col("_gone") & F.col(end).isNull(), at).otherwise(F.col(end))
    return marked.withColumn(end, closed).drop("_gone")


def route(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): rows without a reason, and those with one, which is kept."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def illegal_steps(rows: DataFrame, key: str, state: str, edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows whose state can't follow the one before: no edge (src, dst) leads there and it isn't the same state.

    edges is a state machine of some tens of rows."""
    stepped = rows.withColumn("previous", F.lag(state).over(W.partitionBy(key).orderBy(*order))).where("previous is not null")
    return stepped.where(F.col("previous") != F.col(state)).join(F.broadcast(edges), (F.col("previous") == F.col("src")) & (F.col(state) == F.col("dst")), "left_anti")


def consecutive_failures(rows: DataFrame, key: str, failed: Column, order: Sequence[str]) -> DataFrame:
    """rows with streak: failures in a row up to and with each row, 0 after a success."""
    w = W.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_run", run).withColumn("streak", F.sum(failed.cast("int")).over(W.partitionBy(key, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).drop("_run")
