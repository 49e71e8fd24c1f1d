"""Extremes of windows of each probe's own length, in time linear in probes and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_VALUES = "struct<high:double,low:double,last:struct<at:bigint,id:bigint,price:double>,first:struct<at:bigint,id:bigint,price:double>,n:bigint>"


def _summary(fact: Column, over: W | None = None) -> Column:
    """Aggregates of facts (struct of at, id and price, null for rows that are none), over a window if one is given."""
    parts = {"high": F.max(fact["price"]), "low": F.min(fact["price"]), "last": F.max(fact), "first": F.min(fact), "n": F.count(fact)}
    return F.struct(*[(a.over(over) if over is not None else a).alias(k) for k, a in parts.items()])


def _carried(rows: DataFrame, facts: DataFrame, key: str, block: Column, edge: Column, after: bool, name: str) -> DataFrame:
    """rows with the summary of the facts of their block behind their edge (after) or up to it, carried along in one sort."""
    probe = F.struct(*rows.columns)
    kind = rows.select(probe.alias("p")).schema["p"].dataType
    left = rows.select(F.col(key).alias("_k"), "_w", block.alias("_b"), edge.alias("_at"), F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"), probe.alias("_probe"))
    right = facts.select("_k", "_w", "_b", F.col("_fact.at").alias("_at"), "_fact", F.lit(None).cast(kind).alias("_probe"))
    is_probe = F.col("_probe").isNotNull()
    # of equal instants a fact is not behind the edge, but still up to it
    order = [F.desc("_at"), F.desc(is_probe)] if after else [F.asc("_at"), F.asc(is_probe)]
    over = W.partitionBy("_k", "_w", "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return left.unionByName(right).withColumn(name, _summary(F.col("_fact"), over)).where(is_probe).select("_probe.*", name)


def window_extremes(probes: DataFrame, facts: DataFrame, key: str, after: Column, until: Column) -> DataFrame:
    """probes with high, low, last, first (prices) and n (how many) of the facts of their key in (after, until].

    Time is cut into blocks of a power of two no longer than a probe's window and more than half of it: the window
    is then the end of one block, the beginning of a later one, and at most one whole block between. The ends and beginnings are
    carried along while probes and facts are sorted together by key and block, the whole blocks are aggregates; so no probe is
    paired with its facts. Facts are dealt out once for each power of two that probes need: a few, as
    windows of a day and of ten years are twelve apart. A hot key fills as many tasks as it has blocks.

    facts: key, at, id, price. Newest and first go by (at, id); a newest fact without a price gives no price, as
    elsewhere. Probes whose key or window is null, or whose window is empty, have nulls and n 0; equal probes have each their own row."""
    span = (until - after).cast("long")
    named = probes.withColumns({"_after": after.cast("long"), "_until": until.cast("long"), "_w": F.when((span > 0) & F.col(key).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(span)) - 1))})
    none = F.lit(None).cast(_VALUES)
    idle = named.where("_w is null").select(*named.columns, *[none.alias(x) for x in ("_end", "_begin", "_whole")])
    live = named.where("_w is not null").withColumns({"_b1": F.floor(F.col("_after") / F.col("_w")), "_b2": F.floor(F.col("_until") / F.col("_w"))})
    sizes = live.select("_w").distinct()  # powers of two: 63 at most
    fact = F.struct(F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), F.col("price").cast("double").alias("price"))
    dealt = facts.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), fact.alias("_fact")).join(F.broadcast(sizes)).withColumn("_b", F.floor(F.col("_fact.at") / F.col("_w")))
    ended = _carried(live, dealt, key, F.col("_b1"), F.col("_after"), True, "_end")
    begun = _carried(ended, dealt, key, F.col("_b2"), F.col("_until"), False, "_begin")
    blocks = dealt.groupBy("_k", F.col("_w").alias("_w2"), "_b").agg(_summary(F.col("_fact")).alias("_whole"))
    between = (F.col(key) == F.col("_k")) & (F.col("_w") == F.col("_w2")) & (F.col("_b1") + 1 == F.col("_b")) & (F.col("_b2") - F.col("_b1") == 2)
    whole = begun.join(blocks, between, "left").select(*named.columns, "_end", "_begin", "_whole")
    found = whole.unionByName(idle)
    each = lambda x: [F.col(f"{part}.{x}") for part in ("_begin", "_whole", "_end")]
    return found.select(
        *probes.columns, F.greatest(*each("high")).alias("high"), F.least(*each("low")).alias("low"), F.coalesce(*each("last"))["price"].alias("last"), F.coalesce(*each("first")[::-1])["price"].alias("first"),
        sum((F.coalesce(n, F.lit(0)) for n in each("n")), F.lit(0)).cast("long").alias("n"),
    )
