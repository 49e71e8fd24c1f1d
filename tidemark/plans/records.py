"""Record rules, signals, set operations, filters and dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records
from ..functions.times import instant, micros
from ..operators import claims as claim_ops
from ..operators import accounts, content, ingest, relational, signals
from ..sources import fixtures
from ..sources.tables import claims, events, table
from .catalog import ASOF, query
from .features import A
from .market import SENTENCES_SQL, _any, sentences

SIGNALS = [(1, "Falcon 214/167 japanese reverse holo", ""), (2, "first edition promo P-001 English", "ja"), (3, "alt-art TG05/TG30 zh-hant", " "), (4, "plain words", None), (5, "HOLO in simplified chinese, 031", ""), (6, "normal jp", "en"), (7, "falcon 1234/2000 ja", None), (8, "no. 12/2000", None)]
_SIG = "s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {'NULL' if e is None else repr(e)})" for i, t, e in SIGNALS) + ") v(id, text, given) UNION ALL SELECT 1000 + 100 * conv_id + turn, text, role FROM conversations WHERE role IS NULL OR role <> 'system')"


def _case(tokens: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches(text, '(?i)\b{p}\b') THEN '{c}'" for p, c in tokens) + " END"


@query(rf"WITH {_SIG} SELECT id, coalesce(nullif(trim(given), ''), {_case(records.LANGUAGE_TOKENS)}) AS language, {_case(records.VARIANT_TOKENS)} AS variant, nullif(regexp_extract(text, '{records.COLLECTOR}', 1), '') AS collector FROM s")
def text_infer_signals(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").where("role IS NULL OR role <> 'system'").select((1000 + 100 * F.col("conv_id") + F.col("turn")).alias("id"), "text", F.col("role").alias("given"))
    rows, text = spark.createDataFrame(SIGNALS, "id long, text string, given string").unionByName(said), F.col("text")
    return rows.select("id", records.explicit_or(F.col("given"), records.language(text)).alias("language"), records.variant(text).alias("variant"), records.collector_number(text).alias("collector"))


_SETS_SQL = "sets AS (SELECT row_number() OVER (ORDER BY b) AS place, lower(replace(b, 'Brand#', 'bd')) AS key, b AS name FROM (SELECT DISTINCT p_brand AS b FROM part))"
_SAID_SQL = "said AS (SELECT 1000 + 100 * conv_id + turn AS id, coalesce(text, '') || CASE conv_id % 4 WHEN 0 THEN ' Japanese bRAND#' || (conv_id % 25 + 1) || ' Falcon 214/167 reverse holo' WHEN 1 THEN ' BD' || (conv_id % 25 + 1) || ' promo jp xbd2' ELSE '' END AS text FROM conversations UNION ALL SELECT -doc_id - 1, text FROM documents)"
_VARIANT_WORDS = "|".join(p for p, _ in records.VARIANT_TOKENS if "edition" not in p)


@query(rf"""WITH {_SETS_SQL}, {_SAID_SQL}, hit AS (SELECT id, text, list({{'p': place, 'k': key, 'n': name}} ORDER BY place) FILTER (WHERE place IS NOT NULL) AS hits FROM said LEFT JOIN sets ON contains(lower(text), lower(name)) OR contains(lower(text), key) GROUP BY ALL),
a AS (SELECT id, hits, regexp_replace(text, '{records.COLLECTOR}', ' ') AS t0 FROM hit),
b AS (SELECT id, hits, CASE WHEN hits IS NULL THEN t0 ELSE list_reduce(list_prepend({{'p': 0::BIGINT, 'k': '', 'n': t0}}, hits), lambda x, y: {{'p': 0::BIGINT, 'k': '', 'n': regexp_replace(regexp_replace(x.n, '(?i)' || y.n, ' ', 'g'), '(?i)\b' || y.k || '\b', ' ', 'g')}}).n END AS t1 FROM a)
SELECT id, hits[1].k AS set_key, coalesce(len(hits), 0) AS n_sets, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t1, '{signals.LANGUAGE_WORDS}', ' ', 'g'), '{signals.LANGUAGE_SIGNS}', ' ', 'g'), '(?i)\b({_VARIANT_WORDS})\b', ' ', 'g'), '\s+', ' ', 'g'))) AS residual_sha256 FROM b""")
def text_sets_and_residual(spark: SparkSession, sf: str) -> DataFrame:
    """The sets (brands of parts) named in all conversations and documents, and a digest of what is left of each text."""
    c = F.col
    brands = table(spark, sf, "part").select(c("p_brand").alias("name")).distinct()
    place = F.row_number().over(W.orderBy("name")).cast("long")  # a catalog's sets: a bounded dimension
    sets = brands.select(place.alias("place"), F.lower(F.replace("name", F.lit("Brand#"), F.lit("bd"))).alias("set_key"), "name")
    i = c("conv_id")
    number = (i % 25 + 1).cast("string")
    planted = F.when(i % 4 == 0, F.concat(F.lit(" Japanese bRAND#"), number, F.lit(" Falcon 214/167 reverse holo"))).when(i % 4 == 1, F.concat(F.lit(" BD"), number, F.lit(" promo jp xbd2"))).otherwise("")
    said = table(spark, sf, "conversations").select((1000 + 100 * i + c("turn")).alias("id"), F.concat(F.coalesce("text", F.lit("")), planted).alias("text"))
    said = said.unionByName(table(spark, sf, "documents").select((-c("doc_id") - 1).alias("id"), "text"))
    found = signals.sets_in_texts(said, sets)
    return found.select("id", F.get("sets", F.lit(0))["set_key"].alias("set_key"), F.size("sets").cast("long").alias("n_sets"), F.sha2(signals.residual_name(c("text"), c("sets")), 256).alias("residual_sha256"))


_MT = "CASE l_returnflag WHEN 'N' THEN 'marketplace_listing' WHEN 'R' THEN 'market_price' ELSE CASE WHEN l_linestatus = 'F' THEN 'marketplace_sold' ELSE 'other' END END"


@query(f"WITH m AS (SELECT {_MT} AS market_type, CASE WHEN l_quantity > 25 THEN 'window' END AS aggregation FROM lineitem), p AS (SELECT *, CASE WHEN market_type = 'marketplace_listing' THEN 'asking' WHEN market_type = 'market_price' THEN 'reference' WHEN market_type IN ('marketplace_sold', 'direct_sale') THEN 'sold' ELSE 'reference' END AS price_type FROM m) SELECT market_type, price_type, CASE WHEN market_type = 'marketplace_sold' OR price_type = 'sold' THEN 'sold' WHEN market_type = 'marketplace_listing' THEN 'listing' WHEN aggregation = 'window' THEN 'volume' ELSE 'reference' END AS kind, count(*) AS n FROM p GROUP BY ALL")
def record_classify_facts(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    kind = F.when(flag == "N", "marketplace_listing").when(flag == "R", "market_price").when(F.col("l_linestatus") == "F", "marketplace_sold").otherwise("other")
    rows = table(spark, sf, "lineitem").select(kind.alias("market_type"), F.when(F.col("l_quantity") > 25, "window").alias("aggregation"))
    rows = rows.withColumn("price_type", records.price_type(F.col("market_type")))
    return rows.withColumn("kind", records.fact_kind(F.col("market_type"), F.col("price_type"), F.col("aggregation"))).groupBy("market_type", "price_type", "kind").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, CASE WHEN d = 'bullish' THEN 'positive' WHEN d = 'bearish' THEN 'negative' WHEN c IN ('pull', 'identity') THEN 'neutral' ELSE 'unknown' END AS sentiment, CASE WHEN d IN ('bullish', 'bearish') THEN 0.4 WHEN c IN ('pull', 'identity') THEN 0.3 END::DOUBLE AS confidence, CASE WHEN event_type IN ('click', 'view') THEN 'generic' ELSE 'product' END AS entity_type FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' END AS d, CASE event_id % 3 WHEN 0 THEN 'pull' WHEN 1 THEN 'price' END AS c FROM events)")
def record_sentiment_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    name, sure = records.sentiment(F.when(i % 4 == 0, "bullish").when(i % 4 == 1, "bearish"), F.when(i % 3 == 0, "pull").when(i % 3 == 1, "price"))
    given = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise(" Product ")
    return events(spark, sf).select("id", name.alias("sentiment"), sure.cast("double").alias("confidence"), records.entity_type(given).alias("entity_type"))


@query("SELECT p_partkey AS id, replace(replace(replace('<b>' || p_name || '</b> & \"x\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;').replace('\"', '&quot;') AS html, '/catalog/' || url_encode(p_brand) || '/' || url_encode(p_name) AS url FROM part")
def record_html_url(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("<b>"), "p_name", F.lit('</b> & "x"'))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), records.escape_html(text).alias("html"), F.concat(F.lit("/catalog"), records.url_path(F.col("p_brand"), F.col("p_name"))).alias("url"))


@query("""WITH e AS (SELECT event_id % 1500 AS event_id, user_id AS organization, ts, CASE event_id % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' WHEN 3 THEN 'bogus' WHEN 4 THEN NULL ELSE 'canceled' END AS status, CASE event_id % 3 WHEN 0 THEN 'growth' ELSE 'starter' END AS plan FROM events WHERE event_type = 'error'),
o AS (SELECT event_id, arg_min((ts, organization, status, plan), (ts, organization)) AS x FROM e GROUP BY event_id), s AS (SELECT x[2] AS organization, arg_max((x[3], x[4]), (x[1], event_id)) AS y FROM o GROUP BY 1)
SELECT organization, CASE WHEN y[1] IN ('active', 'trialing', 'past_due', 'canceled') THEN y[1] ELSE 'incomplete' END AS status, CASE WHEN y[1] IN ('active', 'trialing') THEN y[2] ELSE 'free' END AS effective_plan FROM s""")
def source_subscription_events(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    status = F.when(i % 6 == 0, "active").when(i % 6 == 1, "trialing").when(i % 6 == 2, "past_due").when(i % 6 == 3, "bogus").when(i % 6 == 5, "canceled")
    rows = events(spark, sf, "error").select((i % 1500).alias("event_id"), F.col("instrument").alias("organization"), "at", status.alias("status"), F.when(i % 3 == 0, "growth").otherwise("starter").alias("plan"))
    found = fixtures.subscriptions(rows)
    paid = F.col("status").isin("active", "trialing")
    return found.select("organization", records.subscription_status(F.col("status")).alias("status"), F.when(paid, F.col("plan")).otherwise("free").alias("effective_plan"))


@query("""SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'fixture' ELSE 'manual' END AS provider, count(*) AS n, round(sum(CASE WHEN l_linenumber <> 5 THEN l_extendedprice END), 2) AS total, count(*) FILTER (WHERE l_linenumber = 5) AS unpriced
FROM lineitem WHERE l_partkey % 3 = 0 AND l_returnflag = 'R' GROUP BY 1""")
def source_fixture_provider(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as the records of two providers in three languages; one language and kind of each is asked for."""
    c = F.col
    language = F.when(c("l_partkey") % 3 == 0, "en").when(c("l_partkey") % 3 == 1, "ja").otherwise("zh-Hans")
    kind = F.when(c("l_returnflag") == "R", "sold").when(c("l_returnflag") == "N", "listing").otherwise("reference")
    rows = table(spark, sf, "lineitem").select(F.when(c("l_suppkey") % 2 == 0, "fixture").otherwise("manual").alias("provider"), language.alias("language"), kind.alias("kind"), F.when(c("l_linenumber") != 5, c("l_extendedprice")).alias("price"))
    asked = None
    for provider in ("fixture", "manual"):
        found = fixtures.market_records(rows, provider=provider, language="en", kind="sold")
        part = found.agg(F.lit(provider).alias("provider"), F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"), F.count_if(c("price").isNull()).alias("unpriced"))
        asked = part if asked is None else asked.unionByName(part)
    return asked


_KEY = "CASE WHEN event_id % 10 = 0 THEN 'short' WHEN event_id % 10 = 1 THEN 'bad key!!' ELSE 'event:' || (10000000 + event_id) END"


@query(f"""WITH r AS (SELECT event_id AS id, ts, CASE WHEN event_id % 9 = 0 THEN 'plain' ELSE 'metric.' || event_type END AS event_type, {_KEY} AS k, CASE WHEN event_id % 11 = 0 THEN 'Bad.Key' ELSE 'price.usd' END AS mk, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT id, CASE WHEN NOT regexp_matches(event_type, '{records.EVENT_TYPE}') THEN 'event_type' WHEN NOT regexp_matches(k, '{records.IDEMPOTENCY_KEY}') OR length(k) NOT BETWEEN 8 AND 128 THEN 'idempotency_key' WHEN ts > {A} - INTERVAL 9 DAY THEN 'occurred_at' WHEN NOT regexp_matches(mk, '{records.METRIC_KEY}') THEN 'metric_key' WHEN v IS NULL THEN 'metric_value' END AS reason FROM r""")
def record_ingest_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies go through JSON text and back, as they come from the wire."""
    i = F.col("id")
    kind = F.when(i % 9 == 0, "plain").otherwise(F.concat(F.lit("metric."), "event_type"))
    key = F.when(i % 10 == 0, "short").when(i % 10 == 1, "bad key!!").otherwise(F.concat(F.lit("event:"), (i + 10000000).cast("string")))
    metrics = F.array(F.struct(F.when(i % 11 == 0, "Bad.Key").otherwise("price.usd").alias("key"), F.when(i % 13 != 0, F.col("price")).alias("value")))
    body = F.to_json(F.struct(kind.alias("event_type"), key.alias("idempotency_key"), F.col("at").alias("occurred_at"), metrics.alias("metrics")))
    schema = "event_type string, idempotency_key string, occurred_at long, metrics array<struct<key:string,value:double>>"
    rows = events(spark, sf).select("id", F.from_json(body, schema).alias("e"))
    return rows.select("id", ingest.first_failure(records.ingest_rules(F.col("e"), instant("2024-01-20 00:00:00"))).alias("reason"))


@query("SELECT page_id AS id, CASE WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'canonical_url' WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'retention' WHEN page_id % 2 = 0 AND length(html) > 500 THEN 'excerpt' WHEN (page_id % 7) / 5.0 > 1 THEN 'confidence' END AS reason FROM pages")
def record_content_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    rules = records.content_rules(F.col("url"), F.when(i % 2 == 0, F.col("html")), F.when(i % 3 == 0, "reference_only").otherwise("bounded_excerpt"), (i % 7) / 5.0)
    return table(spark, sf, "pages").select(i.alias("id"), ingest.first_failure(rules).alias("reason"))


@query("WITH r AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'threshold' WHEN 1 THEN 'percent' WHEN 2 THEN 'usage' ELSE 'other' END AS kind, (props->>'$.k')::BIGINT * 2 - 20 AS v FROM events) SELECT id, CASE WHEN kind = 'threshold' AND v NOT BETWEEN 0 AND 100 THEN 'threshold' WHEN kind = 'percent' AND v <= 0 THEN 'percent' WHEN kind = 'usage' AND v NOT IN (50, 80, 90, 100) THEN 'usage' WHEN kind = 'other' THEN 'kind' END AS reason FROM r")
def record_alert_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    kind = F.when(i % 4 == 0, "threshold").when(i % 4 == 1, "percent").when(i % 4 == 2, "usage").otherwise("other")
    return events(spark, sf).select("id", ingest.first_failure(records.alert_rules(kind, F.col("k") * 2 - 20)).alias("reason"))


@query("SELECT p_partkey AS id, list_sort(list_distinct(string_split(p_name, ' '))) = ['blue', 'ring'] AS same, len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'bolt'])) AS shared, list_has_all(['red', 'ring', 'bolt'], string_split(p_name, ' ')) AS subset FROM part")
def set_token_operations(spark: SparkSession, sf: str) -> DataFrame:
    tokens, known = F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"), F.lit("bolt"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.array_sort(F.array_distinct(tokens)) == F.array(F.lit("blue"), F.lit("ring"))).alias("same"), F.size(F.array_intersect(tokens, known)).cast("long").alias("shared"), (F.size(F.array_except(tokens, known)) == 0).alias("subset"))


@query("SELECT id, kind FROM (SELECT p_partkey AS id, 'brand' AS kind FROM part WHERE p_brand = 'Brand#1' AND p_size < 10 UNION SELECT p_partkey, 'size' FROM part WHERE p_size = 3 EXCEPT SELECT p_partkey, 'size' FROM part WHERE p_brand = 'Brand#1')")
def set_union_difference(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    tag = lambda rows, kind: rows.select("id", F.lit(kind).alias("kind"))
    brand, size = parts.where("p_brand = 'Brand#1'"), parts.where("p_size = 3")
    return tag(brand.where("p_size < 10"), "brand").unionByName(tag(size, "size")).distinct().exceptAll(tag(brand, "size"))


def pool_or_all(filtered: DataFrame, everything: DataFrame) -> DataFrame:
    """filtered, or everything where filtered is empty: decided in the plan, by a one-row count."""
    some = filtered.agg((F.count("*") > 0).alias("_some"))
    kept = everything.join(F.broadcast(some), how="cross").where(~F.col("_some")).drop("_some")
    return filtered.unionByName(kept)


@query("SELECT count(*) AS matched, (SELECT count(*) FROM part) AS fallback FROM part WHERE p_size = 7")
def set_fallback_pool(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    hit, miss = pool_or_all(parts.where("p_size = 7"), parts), pool_or_all(parts.where("p_size = -1"), parts)
    return hit.agg(F.count("*").alias("matched")).join(miss.agg(F.count("*").alias("fallback")), how="cross")  # one row each


_PRESET = "CASE c_custkey % 7 WHEN 0 THEN '24h' WHEN 1 THEN '7d' WHEN 2 THEN '30d' WHEN 3 THEN '90d' WHEN 4 THEN '1y' ELSE 'all' END"


@query(f"WITH c AS (SELECT c_custkey AS id, {_PRESET} AS preset, CASE c_custkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 365 END AS depth FROM customer) SELECT id, epoch_us(greatest(CASE preset WHEN '24h' THEN {A} - INTERVAL 1 DAY WHEN '7d' THEN {A} - INTERVAL 7 DAY WHEN '30d' THEN {A} - INTERVAL 30 DAY WHEN '90d' THEN {A} - INTERVAL 90 DAY WHEN '1y' THEN {A} - INTERVAL 365 DAY ELSE TIMESTAMP '1970-01-01' END, {A} - depth * INTERVAL 1 DAY)) AS start FROM c")
def filter_window_presets(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey")
    preset = F.when(i % 7 == 0, "24h").when(i % 7 == 1, "7d").when(i % 7 == 2, "30d").when(i % 7 == 3, "90d").when(i % 7 == 4, "1y").otherwise("all")
    depth = F.when(i % 3 == 0, 30).when(i % 3 == 1, 90).otherwise(365)
    return table(spark, sf, "customer").select(i.alias("id"), records.window_start(preset, instant(ASOF), depth).alias("start"))


@query("SELECT o_orderkey AS id, epoch_us(o_orderdate) AS at FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def filter_due_work(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 oldest pending rows that are due: a bounded batch of a queue."""
    due = claims(spark, sf).where((F.col("status") == "P") & (F.col("at") <= instant("1996-01-01 00:00:00")))
    return relational.top_k(due, [F.col("at"), F.col("id")], 20, most=100).select("id", "at")


@query("SELECT o_custkey AS k, 1 AS version, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) GROUP BY 1")
def sink_compute_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Derived facts are computed only for keys that aren't there: the anti-join comes before the work."""
    there = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    todo = table(spark, sf, "orders").join(there, "o_custkey", "left_anti")
    return todo.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).select("k", F.lit(1).alias("version"), "n")


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'all' ELSE 'de' END AS lang, o_orderdate AS d FROM orders)
SELECT k, id, lang FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'all' THEN 1 ELSE 2 END, d DESC, id DESC) AS r FROM s) WHERE r = 1""")
def join_latest_with_preference(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("o_orderkey")
    lang = F.when(i % 3 == 0, "en").when(i % 3 == 1, "all").otherwise("de")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), i.alias("id"), lang.alias("lang"), micros(F.col("o_orderdate")).alias("at"))
    wish = F.when(F.col("lang") == "en", 2).when(F.col("lang") == "all", 1).otherwise(0)
    return rows.withColumn("wish", wish).groupBy("k").agg(F.max_by(F.struct("id", "lang"), F.struct("wish", "at", "id")).alias("r")).select("k", "r.*")


@query("""WITH l AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS id, c_name || ' · ' || n_name AS identity, latest, coalesce(n, 0) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON l.k = c_custkey ORDER BY latest DESC NULLS LAST, id LIMIT 50""")
def dashboard_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Identity and latest value of every key, the 50 largest: a top-k report."""
    latest = claims(spark, sf).groupBy(F.col("forecaster").alias("c_custkey")).agg(F.max_by("price", F.struct("at", "id")).alias("latest"), F.count("*").alias("n"))
    people = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = people.join(latest, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.concat_ws(" · ", "c_name", "n_name").alias("identity"), "latest", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return relational.top_k(rows, [F.desc_nulls_last("latest"), F.col("id")], None)


@query("SELECT o_orderstatus AS status, count(*) AS n, epoch_us(max(o_orderdate)) AS newest FROM orders GROUP BY 1")
def dashboard_ingest_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return claims(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.max("at").alias("newest"))


_TAG = {
    "direction": f"NOT {_any(claim_ops.NON_CLAIM)} AND ({' OR '.join(_any(p) for p in (claim_ops.BULLISH, claim_ops.BEARISH, claim_ops.AVOID, claim_ops.WATCH))})",
    "horizon": " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in claim_ops.HORIZONS.values()),
    "target_price": r"regexp_matches(text, '(?i)target\s*\$?\s*[0-9]') OR regexp_matches(text, '\$\s*[0-9]')",
    "target_percent": r"regexp_matches(text, '[0-9]\s*%')",
    "confidence": r"coalesce(nullif(regexp_extract(text, '(?i)\b([0-9]{1,3})\s*%\s*(?:sure|confident)', 1), '')::DOUBLE <= 100, false)",
}


@query(f"WITH {SENTENCES_SQL} SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _TAG.items()) + ") AS tags FROM s")
def text_evidence_tags(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).select("id", F.array_join(claim_ops.evidence_tags(F.col("text")), ",").alias("tags"))


@query("""WITH r AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'bullish' WHEN 1 THEN 'up' WHEN 2 THEN 'avoid' ELSE 'bearish' END AS d, CASE event_id % 7 WHEN 0 THEN 'soon' ELSE '30d' END AS h, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value - 100 END AS p, (props->>'$.k')::BIGINT / 80.0::DOUBLE AS c FROM events)
SELECT id, d AS direction, p AS target_price FROM r WHERE d <> 'up' AND h <> 'soon' AND (p IS NULL OR p > 0) AND c <= 1 AND id % 11 <> 0""")
def claim_validate_json(spark: SparkSession, sf: str) -> DataFrame:
    """Untrusted JSON: a claim with any field out of range, or cut off, is no claim."""
    i = F.col("id")
    d = F.when(i % 5 == 0, "bullish").when(i % 5 == 1, "up").when(i % 5 == 2, "avoid").otherwise("bearish")
    body = F.to_json(F.struct(d.alias("direction"), F.when(i % 7 == 0, "soon").otherwise("30d").alias("horizon"), F.when(i % 3 != 0, F.col("price") - 100).alias("target_price"), (F.col("k") / 80.0).alias("confidence")))
    raw = F.when(i % 11 == 0, F.substring(body, 1, 15)).otherwise(body)
    return events(spark, sf).select("id", claim_ops.validated(raw).alias("c")).where("c is not null").select("id", "c.direction", "c.target_price")


@query("""WITH t AS (SELECT event_id AS id, ts, user_id AS instrument, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS price FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS id, ts, user_id AS instrument, value AS price FROM events WHERE event_type = 'view'), c AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click')
SELECT c.event_id AS id, coalesce(t.price, v.price) AS price, CASE WHEN t.price IS NOT NULL THEN 'trade' WHEN v.price IS NOT NULL THEN 'reference' END AS price_source FROM c ASOF LEFT JOIN t ON c.user_id = t.instrument AND c.ts >= t.ts ASOF LEFT JOIN v ON c.user_id = v.instrument AND c.ts >= v.ts""")
def claim_price_at(spark: SparkSession, sf: str) -> DataFrame:
    trades = events(spark, sf, "purchase").withColumn("price", F.when(F.col("id") % 4 != 0, F.col("price")))
    probes = events(spark, sf, "click").select("id", "at", "instrument")
    return claim_ops.price_at(probes, trades, events(spark, sf, "view")).select("id", "price", "price_source")


@query("""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ordinal, role, text FROM conversations)
SELECT conv_id, ordinal::INT AS ordinal, role, length(text)::INT AS chars, 'seg_' || substring(sha256(conv_id || '|' || ordinal), 1, 32) AS item_id FROM r""")
def source_explode_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A content's segments as rows with ids that follow from content and ordinal."""
    rows = table(spark, sf, "conversations")
    content = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("segments"))
    return ingest.exploded(content, "segments", "seg_", ["conv_id"]).select("conv_id", "ordinal", F.col("item.role").alias("role"), F.length("item.text").alias("chars"), "item_id")


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_acctbal > 0")
def filter_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are published, to tenants who are entitled and have the feature on."""
    tenants = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE") & (F.col("c_acctbal") > 0)).select(F.col("c_custkey").alias("forecaster"))
    return claims(spark, sf).where("status = 'F'").join(tenants, "forecaster", "left_semi").select("id")


_EVIDENCE_SQL = f"""s AS (SELECT user_id AS instrument, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS sold, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'view' AND (props->>'$.k')::BIGINT > 40) AS score, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events WHERE ts <= {A} GROUP BY 1),
k AS (SELECT instrument, list('creator_call:' || id ORDER BY r) AS calls FROM (SELECT user_id AS instrument, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'click' AND ts <= {A} AND value > 60) WHERE r <= 3 GROUP BY 1),
ev AS (SELECT instrument, n, sold, score, list_concat(list_filter(['market_snapshot:' || sold, 'score_snapshot:' || score, CASE WHEN n >= 9 THEN 'feature_snapshot:f' || instrument END], lambda x: x IS NOT NULL), coalesce(calls, [])) AS sources FROM s LEFT JOIN k USING (instrument)),
e AS (SELECT *, n < 5 OR (sold IS NULL AND score IS NULL) OR len(sources) < 2 OR (n >= 9)::INT + (score IS NOT NULL)::INT < 1 AS thin, CASE WHEN instrument % 7 = 0 THEN 'ja' ELSE 'en' END AS language, CASE WHEN instrument % 11 <> 0 THEN 'en' END AS identity_language, CASE WHEN instrument % 5 <> 0 THEN 'pk-en-' || instrument END AS identity_key, instrument % 13 = 0 AS comparative FROM ev)"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    c, rows = F.col, events(spark, sf).where(F.col("at") <= instant(ASOF))
    newest = lambda where: F.max_by("id", F.when(where, F.struct("at", "id")))
    sold = c("event_type") == "purchase"
    found = rows.groupBy("instrument").agg(newest(sold).alias("sold"), newest((c("event_type") == "view") & (c("k") > 40)).alias("score"), F.count_if(sold).alias("n"))
    calls = content.newest_calls(rows.where("event_type = 'click' and price > 60"), "instrument")
    found = found.join(calls, "instrument", "left")
    i = c("instrument")
    found = found.withColumn("sources", content.sources({"market_snapshot": c("sold"), "score_snapshot": c("score"), "feature_snapshot": F.when(c("n") >= 9, F.concat(F.lit("f"), i))}, c("calls")))
    signals_ = (c("n") >= 9).cast("int") + c("score").isNotNull().cast("int")
    thin = accounts.thin_evidence(F.lit(True), c("sold").isNotNull(), c("score").isNotNull(), F.when(c("n") < 5, "insufficient_data").otherwise("buy"), F.size("sources"), signals_, F.lit(1), 2, 1)
    return found.select("instrument", "sources", thin.alias("thin"), F.when(i % 7 == 0, "ja").otherwise("en").alias("language"), F.when(i % 11 != 0, "en").alias("identity_language"), F.when(i % 5 != 0, F.concat(F.lit("pk-en-"), i)).alias("identity_key"), (i % 13 == 0).alias("comparative"))


@query(f"WITH {_EVIDENCE_SQL} SELECT instrument, array_to_string(sources, ',') AS sources, thin FROM e")
def content_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What may be written about each instrument: its newest snapshots and its three newest calls as one list."""
    shown = F.array_join(F.transform("sources", lambda s: F.concat(s["type"], F.lit(":"), s["id"])), ",")
    return _evidence(spark, sf).select("instrument", shown.alias("sources"), "thin")


_KINDS = tuple(content.LEAST_CHARS)


@query(f"""WITH {_EVIDENCE_SQL}, kinds AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', {n})" for i, (k, n) in enumerate(content.LEAST_CHARS.items()))}) v(i, output_type, least)),
d AS (SELECT doc_id AS draft, doc_id % 160 AS instrument, output_type, least, CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE 'v1' END AS version, coalesce(text, '') AS body, doc_id % 17 = 0 AS script FROM documents JOIN kinds ON i = doc_id % 9),
c AS (SELECT draft, 'c' || j AS key, CASE WHEN draft % 5 = 0 AND j = 1 THEN 'none' WHEN j = 2 THEN (e.score)::VARCHAR ELSE e.sold::VARCHAR END AS source, e.sources FROM d JOIN e USING (instrument), range(3) r(j) WHERE j < draft % 4),
u AS (SELECT draft, count(*) AS n, list('unresolved_claim:' || key ORDER BY key) FILTER (WHERE source IS NULL OR NOT list_contains(list_transform(sources, lambda x: split_part(x, ':', 2)), source)) AS bad FROM c GROUP BY draft)
SELECT draft, array_to_string(CASE WHEN e.instrument IS NULL THEN ['evidence_missing'] ELSE list_concat(list_filter([CASE WHEN trim(version) = '' THEN 'model_version_missing' END, CASE WHEN NOT thin AND length(body) < least THEN 'min_substance' END, CASE WHEN thin AND length(body) < 40 THEN 'stub_too_short' END, CASE WHEN identity_language IS NOT NULL AND identity_language <> language THEN 'language_mismatch' END,
 CASE WHEN NOT comparative AND identity_key IS NOT NULL AND NOT contains(identity_key, language) THEN 'cross_language_merge' END], lambda x: x IS NOT NULL), coalesce(u.bad, []), list_filter([CASE WHEN NOT thin AND coalesce(u.n, 0) = 0 THEN 'numeric_claims_missing' END, CASE WHEN script THEN 'unsafe_html' END, CASE WHEN NOT thin AND output_type = 'card_analysis' AND length(body) < 400 THEN 'min_substance' END], lambda x: x IS NOT NULL)) END, ',') AS failures
FROM d LEFT JOIN e USING (instrument) LEFT JOIN u USING (draft)""")
def content_draft_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as drafts about instruments, with claims of which some name no source of their evidence."""
    c = F.col
    found = _evidence(spark, sf).withColumnRenamed("instrument", "evidence")
    i = c("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (i % 9 + 1).cast("int"))
    drafts = table(spark, sf, "documents").select(i.alias("draft"), (i % 160).alias("evidence"), kind.alias("output_type"), F.when(i % 23 == 0, " ").otherwise("v1").alias("generator_version"), c("text").alias("body_text"), F.when(i % 17 == 0, F.concat(F.lit("<p><script"), i)).otherwise("<p>").alias("body_html"))
    of = lambda kind: F.get(F.filter("sources", lambda s: s["type"] == kind), F.lit(0))["id"]
    known = found.select("evidence", of("market_snapshot").alias("sold"), of("score_snapshot").alias("score"))
    j = c("j")
    claims = drafts.select("draft", "evidence").join(known, "evidence").withColumn("j", F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda x: x < c("draft") % 4)))
    source = F.when((c("draft") % 5 == 0) & (j == 1), "none").when(j == 2, c("score")).otherwise(c("sold"))
    claims = claims.select("draft", F.concat(F.lit("c"), j).alias("claim_key"), source.alias("source_id"))
    return content.draft_failures(drafts, claims, found).select("draft", F.array_join("failures", ",").alias("failures"))
