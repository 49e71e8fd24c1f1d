"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .staging import broadcast_if_small, cut

#: A word, as everywhere in this subpackage: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with place: their place by code point from 0, null last, with no task that sees them all."""
    parts = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    own = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("own") - 1).drop("part", "own", "n", "before")


def water_fill(sources: DataFrame, cap: float) -> DataFrame:
    """sources (with size and weight) with target: all sizes shared by weight, at most cap times a source's own size.

    The excess of capped sources goes to the others by weight until none is above its cap. Each round
    is one aggregate; the driver sees its sums alone."""
    limit = F.col("size") * F.lit(float(cap))
    total, weights = sources.agg(F.sum("size"), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    rate, left = total / weights, None
    while True:
        over = limit < F.lit(rate) * F.col("weight")
        capped, free = sources.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if free is None or free == left:
            break
        left, rate = free, (total - (capped or 0.0)) / free
    return sources.withColumn("target", F.least(limit, F.lit(rate) * F.col("weight")))


def source_rates(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """One row per source of sized (source, size): _source, source_size, target and _rate."""
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("size")))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    filled = water_fill(cut(_ranked(sources).withColumn("weight", turn)), cap)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    return cut(filled.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", rate.alias("_rate")))


def _take(rows: DataFrame, rates: DataFrame, seed: int, broadcast_rows: int) -> DataFrame:
    """rows joined to their source's rate, with _copies: how often each is taken."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return rows.join(broadcast_if_small(rates, broadcast_rows), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies.cast("int"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 20, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, source, size (words), source_size, target (of the source) and copies of each row of docs.

    Sources by code point, null last, take the weights in turn and share the words of the whole corpus;
    no target exceeds cap times its source's size. A source's repetition rate is target / source_size: each
    document is taken floor(rate) times, and once more if a hash of the seed and its doc_id falls below the
    rate's fraction, so reruns agree. Takes doc_id, text and source; others are ignored. Only sources are
    aggregated and, up to broadcast_rows of them, broadcast; beyond that they are joined by a shuffle.

    Defined cases: a null or blank text has size 0; the null source is a source; a source without words has
    rate 0; rows that repeat a doc_id draw alike; a null doc_id draws by the seed alone."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = _take(sized, source_rates(sized, weights, cap), seed, broadcast_rows)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("_copies").alias("copies"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 20, broadcast_rows: int = 100_000) -> DataFrame:
    """The mixed corpus: each row of docs as often as mix_plan takes it, columns unchanged."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    whole = docs.select("doc_id", "source", F.struct("*").alias("_row"))  # so that no column of docs can clash
    taken = _take(whole, source_rates(sized, weights, cap), seed, broadcast_rows).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
