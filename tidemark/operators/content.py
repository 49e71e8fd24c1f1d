"""Evidence for an instrument, and drafts checked against it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Characters that a kind of output needs, and that a page needs to be indexed.
LEAST_CHARS = {"seo_article": 400, "market_report": 400, "card_analysis": 400, "newsletter": 200, "email": 120, "social_post": 80, "youtube_outline": 160, "push_notification": 40, "tenant_report": 40}
INDEXABLE, STUB = 400, 40
#: The newest calls that are evidence.
CALLS = 3


def newest_calls(calls: DataFrame, key: str, most: int = CALLS) -> DataFrame:
    """key and calls: the ids of each key's newest calls (at, id), newest first; at most most of a key are gathered."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("at"), F.desc("id")))
    top = calls.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "id"))), lambda x: x["id"].cast("string")).alias("calls"))


def sources(parts: Mapping[str, Column], calls: Column) -> Column:
    """One list of unlike sources (type, id): those of parts that are there, in order, and then the calls."""
    single = F.array(*[F.when(i.isNotNull(), F.struct(F.lit(kind).alias("type"), i.cast("string").alias("id"))) for kind, i in parts.items()])
    called = F.transform(F.coalesce(calls, F.array().cast("array<string>")), lambda i: F.struct(F.lit("creator_call").alias("type"), i.alias("id")))
    return F.concat(F.array_compact(single), called)


def draft_failures(drafts: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """drafts with failures (names, in order of the checks; unresolved claims by key) and passed.

    drafts: draft, evidence, output_type, generator_version, body_text, body_html. claims: draft, claim_key, source_id.
    evidence: evidence, language, identity_language, identity_key, comparative, thin, sources (type, id). A claim is resolved if its source is one of
    its own draft's evidence: claims meet sources by both keys, and no draft is compared with evidence that isn't its own.
    A draft without evidence fails by that alone."""
    e = evidence.select("evidence", F.struct("language", "identity_language", "identity_key", "comparative", "thin").alias("_e"))
    known = evidence.select("evidence", F.explode("sources").alias("s")).select("evidence", F.col("s.id").alias("source_id"), F.lit(True).alias("_known")).distinct()
    checked = claims.join(drafts.select("draft", "evidence"), "draft").join(known, ["evidence", "source_id"], "left")
    checked = checked.groupBy("draft").agg(F.count("*").alias("_claims"), F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), F.concat(F.lit("unresolved_claim:"), "claim_key")))).alias("_open"))
    met = drafts.join(e, "evidence", "left").join(checked, "draft", "left")
    thin, text = F.col("_e.thin"), F.coalesce("body_text", F.lit(""))
    least = F.coalesce(*[F.when(F.col("output_type") == kind, n) for kind, n in LEAST_CHARS.items()], F.lit(0))
    own, language, key = F.coalesce("_e.identity_language", F.lit("")), F.coalesce("_e.language", F.lit("")), F.coalesce("_e.identity_key", F.lit(""))
    named = lambda checks: F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks]))
    before = named([
        ("model_version_missing", F.trim(F.coalesce("generator_version", F.lit(""))) == ""), ("min_substance", ~thin & (F.length(text) < least)), ("stub_too_short", thin & (F.length(text) < STUB)),
        ("language_mismatch", (own != "") & (own != language)), ("cross_language_merge", ~F.col("_e.comparative") & (key != "") & (language != "") & ~F.contains(key, language)),
    ])
    after = named([("numeric_claims_missing", ~thin & (F.coalesce("_claims", F.lit(0)) == 0)), ("unsafe_html", F.contains(F.coalesce("body_html", F.lit("")), F.lit("<script"))), ("min_substance", ~thin & (F.col("output_type") == "card_analysis") & (F.length(text) < INDEXABLE))])
    failures = F.when(F.col("_e").isNull(), F.array(F.lit("evidence_missing"))).otherwise(F.concat(before, F.coalesce("_open", F.array().cast("array<string>")), after))
    return met.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0).select(*drafts.columns, "failures", "passed")
