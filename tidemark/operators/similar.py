"""Joins of names that are alike, by filters that lose no pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack for bounds that are computed in doubles: filters may let more through, never less.
EPS = 1e-6


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def dice(a: Column, b: Column) -> Column:
    """Overlap of two texts' token sets."""
    x, y = tokens(a), tokens(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


def name_similarity(a: Column, b: Column) -> Column:
    return F.greatest(edit_similarity(a, b), dice(a, b))


def _floor(x: Column) -> Column:
    return F.floor(x + EPS).cast("int")


def _segments(length: Column, least: float) -> Column:
    """Into how many parts a name of that length is cut: one more than the edits that any name alike can be away.

    A partner has at most length / least characters, so the edits are at most (1 - least) of that."""
    return _floor((1 - least) * _floor(length / least)) + 1


def _segment(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of part i, counted from 0; the last ones are a character longer where it doesn't come out even."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    return i * base + F.greatest(i - (parts - longer), F.lit(0)), base + F.when(i >= parts - longer, 1).otherwise(0)


def _close_by_edits(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Candidate pairs (name, other) for edit similarity: a part of other stands in name at a place that few edits can shift it to.

    With one part more than edits, one part is untouched. Edits before it shift it by x, edits behind it by the rest of the
    difference in length, and |x| + |difference - x| is at most the number of edits."""
    n = F.length("other")
    cut = others.withColumns({"_n": n, "_parts": _segments(n, least)}).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    at, size = _segment(F.col("_n"), F.col("_parts"), F.col("_i"))
    keyed = cut.select("other", F.xxhash64("_n", "_i", F.substring("other", at + 1, size)).alias("_key"))
    s = F.length("name")
    probes = names.withColumn("_s", s).withColumn("_n", F.explode(F.sequence(F.greatest(F.ceil(s * least - EPS).cast("int"), F.lit(1)), _floor(s / least))))
    probes = probes.withColumn("_parts", _segments(F.col("_n"), least)).withColumns({"_d": _floor((1 - least) * F.greatest("_s", "_n")), "_by": F.col("_s") - F.col("_n"), "_i": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
    at, size = _segment(F.col("_n"), F.col("_parts"), F.col("_i"))
    probes = probes.withColumns({"_at": at, "_size": size, "_low": -F.floor((F.col("_d") - F.col("_by")) / 2).cast("int"), "_high": F.floor((F.col("_d") + F.col("_by")) / 2).cast("int")})
    probes = probes.where("_low <= _high").withColumn("_p", F.explode(F.sequence(F.col("_at") + F.col("_low"), F.col("_at") + F.col("_high")))).where("_p >= 0 and _p + _size <= _s")
    found = probes.select("name", F.xxhash64("_n", "_i", F.substring("name", F.col("_p") + 1, F.col("_size"))).alias("_key")).distinct()
    return found.join(keyed, "_key").select("name", "other").distinct()


def _close_by_tokens(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Candidate pairs for overlap: of a tokens, least * a / (2 - least) must be shared, so the rarest of the others but one decide.

    Both sides keep their a - that + 1 rarest tokens by one order; sets that overlap enough share one of them."""
    frequency = others.select(F.explode(tokens(F.col("other"))).alias("_token")).groupBy("_token").agg(F.count("*").alias("_f"))

    def rarest(rows: DataFrame, column: str) -> DataFrame:
        each = rows.select(column, F.explode(tokens(F.col(column))).alias("_token")).join(frequency, "_token", "left")
        listed = each.groupBy(column).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_token").alias("t")))).alias("_all"))  # a name's own tokens
        a = F.size("_all")
        kept = F.slice("_all", F.lit(1), a - F.ceil(a * (least / (2 - least)) - EPS).cast("int") + 1)
        return listed.select(column, F.explode(F.transform(kept, lambda x: x["t"])).alias("_token"))

    return rarest(names, "name").join(rarest(others, "other"), "_token").select("name", "other").distinct()


def similar_names(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(name, other, sim): all pairs of distinct names and others with name_similarity of least or more.

    Pairs alike by edits share an untouched part near its place; pairs alike by tokens share one of their rarest. Both
    joins are on keys alone, so a name meets what shares a key with it and not the catalog; the similarity is then computed for
    each candidate. Equal names are pairs of similarity 1. Empty and null names are no names. 0 < least <= 1."""
    a = names.select("name").where("name is not null and name <> ''").distinct()
    b = others.select("other").where("other is not null and other <> ''").distinct()
    pairs = _close_by_edits(a, b, least).unionByName(_close_by_tokens(a, b, least)).distinct()
    sim = F.when(F.col("name") == F.col("other"), 1.0).otherwise(name_similarity(F.col("name"), F.col("other")))
    return pairs.withColumn("sim", sim).where(F.col("sim") >= least)
