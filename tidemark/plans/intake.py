"""Queries over untrusted input: states of ingested records, redaction, fingerprints, names, JSON streams, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import fingerprint, normalized_name
from ..operators import accounts, ingest, relational
from ..session import materialised
from ..sources.tables import events, table
from ..streaming import ingest as streaming
from .catalog import query
from .operations import FEED, feed

_RECORDS = FEED + """,
r AS (SELECT feed.*, CASE WHEN l_linenumber % 5 = 0 AND seq < 2 THEN NULL ELSE p_brand END AS brand, CASE WHEN l_partkey % 9 = 0 THEN 'NONE' ELSE p_type END AS kind, p_size AS size, CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE 'en' END AS language, CASE WHEN l_orderkey % 6 = 0 THEN 'x' || CASE WHEN l_orderkey % 12 = 0 THEN l_partkey + 1000000000 ELSE l_partkey END END AS external FROM feed JOIN part ON p_partkey = l_partkey),
k AS (SELECT p_brand, p_type, p_size, count(*) AS n, min(p_partkey) AS target FROM part GROUP BY ALL),
s AS (SELECT r.*, CASE WHEN external IS NULL AND (brand IS NULL OR language IS NULL) THEN 'concept_only' WHEN external IS NOT NULL AND e.p_partkey IS NULL THEN 'not_found' WHEN external IS NULL AND k.n IS NULL THEN 'not_found' WHEN external IS NULL AND k.n > 1 THEN 'ambiguous' END AS reason, coalesce(e.p_partkey, k.target) AS found
 FROM r LEFT JOIN part e ON external = 'x' || e.p_partkey LEFT JOIN k ON k.p_brand = r.brand AND k.p_type = r.kind AND k.p_size = r.size),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY seq, fp, reason NULLS FIRST) AS pos FROM s),
q AS (SELECT *, min(CASE WHEN reason IS NULL THEN pos END) OVER w AS first_pos, arg_min(fp, CASE WHEN reason IS NULL THEN pos END) OVER w AS first_fp FROM o WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))"""


@query(f"""WITH {_RECORDS}, z AS (SELECT *, CASE WHEN first_pos IS NULL OR pos < first_pos THEN 'quarantined' WHEN pos = first_pos THEN 'processed' WHEN fp = first_fp THEN 'duplicate' ELSE 'revision' END AS state FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seq, state, CASE WHEN state = 'quarantined' THEN reason END AS reason, CASE WHEN state = 'processed' THEN found END AS target FROM z""")
def ingest_market_states(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of line items as provider records, parts as the catalog. What comes again may say what was lacking before."""
    c, parts = F.col, table(spark, sf, "part")
    rows = feed(spark, sf).join(parts, c("l_partkey") == c("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seq", "fp", F.when((c("l_linenumber") % 5 != 0) | (c("seq") >= 2), c("p_brand")).alias("brand"), F.when(c("l_partkey") % 9 == 0, "NONE").otherwise(c("p_type")).alias("kind"), c("p_size").alias("size"),
        F.when(c("l_suppkey") % 8 != 0, "en").alias("language"), F.when(c("l_orderkey") % 6 == 0, F.concat(F.lit("x"), F.when(c("l_orderkey") % 12 == 0, c("l_partkey") + 1000000000).otherwise(c("l_partkey")))).alias("external"),
    )
    catalog = parts.select(c("p_partkey").alias("target"), c("p_brand").alias("brand"), c("p_type").alias("kind"), c("p_size").alias("size"), F.concat(F.lit("x"), "p_partkey").alias("external"))
    states = ingest.record_states(rows, catalog, ["l_orderkey", "l_linenumber"], "fp", ["seq"], ["brand", "kind", "size"], ["brand", "language"])
    return states.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seq", "state", "reason", "target")


_SECRETS = "coalesce(text, '') || CASE conv_id % 5 WHEN 0 THEN ' use sk_live or API-key' WHEN 1 THEN ' Bearer abc123 Password' ELSE '' END"


@query(f"SELECT conv_id, turn, regexp_replace({_SECRETS}, '{ingest.SECRET}', '[redacted]', 'g') AS text FROM conversations")
def record_redaction(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("conv_id") % 5
    planted = F.when(i == 0, " use sk_live or API-key").when(i == 1, " Bearer abc123 Password").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", ingest.redact(F.concat(F.coalesce("text", F.lit("")), planted)).alias("text"))


@query("""SELECT event_id AS id, sha256('{"a":[1,2],"k":' || (props->>'$.k') || ',"z":{"b":"' || event_type || '","c":null}}') AS fp FROM events""")
def kernel_document_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """The order of a document's keys, at any depth, and its white space don't matter."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    odd = F.concat(F.lit('{ "z": {"c": null, "b": "'), kind, F.lit('"}, "k": '), k, F.lit(', "a": [1, 2]}'))
    even = F.concat(F.lit('{"a":[1,2],"z":{"b":"'), kind, F.lit('","c":null},"k":'), k, F.lit("}"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), fingerprint(F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)).alias("fp"))


@query("SELECT c_custkey AS id, lower(c_name) || ' fi 1/2' AS name FROM customer".replace("1/2", "1⁄2"))
def kernel_normalized_names(spark: SparkSession, sf: str) -> DataFrame:
    """Full-width letters, ligatures and fractions fold to plain ones."""
    wide = F.translate("c_name", "Cusr#", "Ｃｕｓｒ＃")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), normalized_name(F.concat(F.lit("  "), wide, F.lit("  ﬁ\t½ "))).alias("name"))


_LINES = """l AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN '{"broken":' WHEN event_id % 11 = 0 THEN 'long' ELSE 'ok' END AS kind, user_id, value FROM events)"""


@query(f"WITH {_LINES} SELECT id, CASE kind WHEN 'long' THEN 'too_large' WHEN 'ok' THEN NULL ELSE 'malformed' END AS reason, CASE WHEN kind = 'ok' THEN user_id END AS organization, CASE WHEN kind = 'ok' THEN value END AS value FROM l")
def stream_json_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of JSON, some cut off and some beyond the size limit, through a stream into a table."""
    rows = streaming.event_files(spark, sf, "events.parquet")
    good = F.to_json(F.struct(F.col("user_id").alias("organization"), "value"))
    line = F.when(F.col("event_id") % 7 == 0, '{"broken":').when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"note":"'), F.repeat(F.lit("x"), F.lit(300)), F.lit('"}'))).otherwise(good)
    parsed = streaming.json_events(rows.select(F.col("event_id").alias("id"), line.alias("value")), "organization long, value double", 256)
    return streaming.run_to_table(parsed.select("id", "reason", F.col("event.organization").alias("organization"), F.col("event.value").alias("value")), "append")


_STAGES = tuple(accounts.LIFECYCLE)
_STAGE_SQL = "CASE c_custkey % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STAGES)) + " END"


@query(f"""WITH c AS (SELECT c_custkey AS organization, {_STAGE_SQL} AS stage, CASE c_custkey % 7 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' WHEN 3 THEN 'unpaid' WHEN 4 THEN 'canceled' ELSE 'none' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'free' ELSE 'growth' END AS plan, c_custkey % 4 = 0 AS activated, c_custkey % 11 = 0 AS risk FROM customer)
SELECT organization, stage, CASE WHEN status = 'canceled' THEN CASE WHEN stage = 'churned' THEN 'churned' ELSE 'canceled' END WHEN status IN ('past_due', 'unpaid') THEN 'past_due' WHEN risk AND status IN ('active', 'trialing') THEN 'at_risk' WHEN status = 'active' AND plan <> 'free' THEN 'customer' WHEN status = 'trialing' THEN 'trial' WHEN activated THEN 'activated' WHEN stage = 'lead' THEN 'signup' WHEN stage = 'signup' THEN 'onboarding' ELSE stage END AS suggested FROM c""")
def crm_lifecycle_suggest(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey")
    stage = F.element_at(F.array(*[F.lit(s) for s in _STAGES]), (i % 10 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "trialing", "past_due", "unpaid", "canceled", "none", "none")]), (i % 7 + 1).cast("int"))
    plan = F.when(i % 3 == 0, "free").otherwise("growth")
    return table(spark, sf, "customer").select(i.alias("organization"), stage.alias("stage"), accounts.suggested_stage(stage, status, plan, i % 4 == 0, i % 11 == 0).alias("suggested"))


@query("SELECT event_id AS id, user_id AS organization, least(greatest((props->>'$.k')::BIGINT, 0), 100) / 100.0::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1")
def score_to_decision(spark: SparkSession, sf: str) -> DataFrame:
    """The newest score of each organisation as a decision, inserted where its id isn't stored yet.

    A first run stores the even organisations; a second takes all scores in, and a third takes them in again."""
    scores = events(spark, sf, "purchase").select("id", F.col("instrument").alias("organization"), "at", F.col("k").alias("score"))
    newest = scores.groupBy("organization").agg(F.max_by(F.struct("id", "score"), F.struct("at", "id")).alias("s"))
    held = F.least(F.greatest(F.col("s.score"), F.lit(0)), F.lit(100))
    decisions = materialised(newest.select(F.col("s.id").alias("id"), "organization", (held / 100).alias("confidence")))
    stored = materialised(decisions.where("organization % 2 = 0"))
    for _ in range(2):
        stored = materialised(stored.unionByName(relational.insert_absent(stored, decisions, ["id"], ["id"])))
    return stored
