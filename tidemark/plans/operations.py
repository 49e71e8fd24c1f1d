"""Catalog, resolution, ingest and tenant queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import cursor, joined, key_of, squeezed, stable_id
from ..functions.stats import price_tier
from ..functions.times import DAY, instant, micros, trailing
from ..operators import accounts, ingest, relational, resolve
from ..sources.tables import claims, events, table
from .catalog import ASOF, query
from .features import A, _in


def _star(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    # nation and region are fixed dimensions of a few rows
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)


@query("SELECT s_suppkey AS id, concat_ws(' · ', s_name, n_name, r_name) AS identity, CASE WHEN s_acctbal IS NULL THEN 'unknown' WHEN s_acctbal < 25 THEN 'lt_25' WHEN s_acctbal < 100 THEN '25_100' WHEN s_acctbal < 500 THEN '100_500' ELSE 'gte_500' END AS tier FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def catalog_star_join(spark: SparkSession, sf: str) -> DataFrame:
    return _star(spark, sf).select(F.col("s_suppkey").alias("id"), F.concat_ws(" · ", "s_name", "n_name", "r_name").alias("identity"), price_tier(F.col("s_acctbal")).alias("tier"))


@query("SELECT s_suppkey AS id, s_name AS name, (SELECT count(*) FROM supplier WHERE s_suppkey > 10) > 20 AS has_more, rtrim(translate(base64(s_suppkey::VARCHAR::BLOB), '+/', '-_'), '=') AS next_cursor FROM supplier WHERE s_suppkey > 10 ORDER BY s_suppkey LIMIT 20")
def catalog_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    page = relational.keyset_page(table(spark, sf, "supplier"), "s_suppkey", 10, 20)
    return page.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "has_more", cursor(F.col("s_suppkey")).alias("next_cursor"))


@query("SELECT s_suppkey AS id, s_suppkey::VARCHAR AS back FROM supplier")
def catalog_cursor_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), key_of(cursor(F.col("s_suppkey"))).alias("back"))


@query("""WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_partkey % 7 = 0 THEN 'NONE' ELSE p_type END AS kind, p_size AS size FROM part),
f AS (SELECT m.id, count(DISTINCT p.p_partkey) AS matches, min(p.p_partkey) AS t FROM m LEFT JOIN part p ON p.p_brand = m.brand AND p.p_type = m.kind AND p.p_size = m.size GROUP BY m.id)
SELECT m.id, matches, CASE WHEN brand IS NULL THEN 'incomplete' WHEN matches = 0 THEN 'not_found' WHEN matches > 1 THEN 'ambiguous' ELSE 'exact' END AS status, CASE WHEN brand IS NOT NULL AND matches = 1 THEN t END AS target FROM m JOIN f USING (id)""")
def catalog_exact_resolve(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    key = F.col("p_partkey")
    mentions = parts.select(key.alias("id"), F.when(key % 11 != 0, F.col("p_brand")).alias("brand"), F.when(key % 7 == 0, "NONE").otherwise(F.col("p_type")).alias("kind"), F.col("p_size").alias("size"))
    catalog = parts.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), key.alias("target"))
    return resolve.exact(mentions, catalog, ["brand", "kind", "size"], "target").select("id", "matches", "status", "target")


_FUZZY = """n AS (SELECT p_partkey AS id, p_brand, p_type, p_size, replace(p_name, 'e', CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'e' END) AS name FROM part),
x AS (SELECT n.id, p.p_partkey AS target, n.name AS a, p.p_name AS b FROM n JOIN part p ON p.p_brand = n.p_brand AND p.p_type = n.p_type AND p.p_size = n.p_size),
y AS (SELECT id, target, CASE WHEN greatest(length(a), length(b)) > 0 THEN 1 - levenshtein(a, b) / greatest(length(a), length(b)) ELSE 0 END AS edit, list_distinct(list_filter(string_split(a, ' '), lambda w: w <> '')) AS ta, list_distinct(list_filter(string_split(b, ' '), lambda w: w <> '')) AS tb FROM x),
z AS (SELECT id, target, greatest(edit, CASE WHEN len(ta) + len(tb) > 0 THEN 2.0 * len(list_intersect(ta, tb)) / (len(ta) + len(tb)) ELSE 0 END) AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, target) AS rank FROM z WHERE score >= 0.5)"""


def _fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    wrong = F.when(F.col("p_partkey") % 3 == 0, "a").otherwise("e")
    block = ["p_brand", "p_type", "p_size"]
    mentions = parts.select(F.col("p_partkey").alias("id"), *block, F.replace(F.col("p_name"), F.lit("e"), wrong).alias("name"))
    catalog = parts.select(F.col("p_partkey").alias("target"), *block, F.col("p_name").alias("candidate"))
    return resolve.fuzzy_candidates(mentions, catalog, block, "target")


@query(f"WITH {_FUZZY} SELECT id, target, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 12")
def resolve_fuzzy_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _fuzzy(spark, sf).withColumn("score", F.round("score", 6))


@query(f"""WITH {_FUZZY}, d AS (SELECT id, max(score) FILTER (WHERE rank = 1) AS top, max(score) FILTER (WHERE rank = 2) AS second, arg_min(target, rank) AS t FROM r WHERE rank <= 12 GROUP BY id),
s AS (SELECT id, t, CASE WHEN top >= 0.86 AND top - coalesce(second, 0) >= 0.05 THEN 'high_confidence' WHEN top - coalesce(second, 0) < 0.05 THEN 'ambiguous' WHEN top >= 0.6 THEN 'probable' ELSE 'unresolved' END AS status FROM d)
SELECT id, status, CASE WHEN status = 'high_confidence' THEN t END AS target FROM s""")
def resolve_decide(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.decide(_fuzzy(spark, sf), "target")


_CATALOG = """c AS (SELECT p_partkey AS target, p_name AS concept, CASE WHEN p_partkey % 4 = 0 THEN [p_name, p_name || ' xl'] ELSE [p_name] END AS names, p_type AS game, p_brand AS set_key, p_size AS number, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'ja' END AS language,
 CASE WHEN p_partkey % 11 < 2 THEN 'holo' ELSE 'normal' END AS variant, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'rare' ELSE 'common' END AS rarity, CASE WHEN p_partkey % 7 < 3 THEN 'matte' ELSE 'gloss' END AS finish, p_partkey % 10 = 0 AS promo, 'x' || p_partkey AS external FROM part)"""
_MENTIONS = """m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 19 <> 0 THEN CASE WHEN p_partkey % 8 = 0 THEN p_name || ' xl' WHEN p_partkey % 9 = 1 THEN p_name[:2] || p_name[4:] WHEN p_partkey % 29 = 1 THEN 'nothing alike ' || p_partkey ELSE replace(p_name, 'e', CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'e' END) END END AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS game,
 CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 3 THEN p_brand END AS set_key, CASE WHEN p_partkey % 7 = 3 THEN NULL WHEN p_partkey % 17 = 0 THEN -1 WHEN p_partkey % 4 <> 0 THEN p_size END AS number, CASE WHEN p_partkey % 6 >= 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'ja' END END AS language,
 CASE WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 11 < 2 THEN 'holo' ELSE 'normal' END END AS variant, CASE WHEN p_partkey % 31 = 0 THEN 'rare' END AS rarity, CASE WHEN p_partkey % 23 = 0 THEN 'matte' END AS finish, CASE WHEN p_partkey % 37 = 0 THEN true END AS promo, p_partkey % 2 = 1 AS context,
 CASE p_partkey % 13 WHEN 0 THEN 'x' || p_partkey WHEN 1 THEN 'x' || (p_partkey + 1) WHEN 2 THEN 'none' END AS external, CASE WHEN p_partkey % 7 = 0 THEN 'ja' END AS content_language FROM part)"""
_OK = {a: f"coalesce(m.{a} = c.{a}, false)" for a in (*resolve.HARD, *resolve.SOFT)}
_BAD = {a: f"(m.{a} IS NOT NULL AND m.{a} IS DISTINCT FROM c.{a})" for a in _OK}
_NAME_SQL = "list_max(list_transform(c.names, lambda n: CASE WHEN n = m.name THEN 1.0::DOUBLE ELSE greatest(1 - levenshtein(n, m.name) / greatest(length(n), length(m.name)), 2.0::DOUBLE * len(list_intersect(list_distinct(string_split(n, ' ')), list_distinct(string_split(m.name, ' ')))) / (len(list_distinct(string_split(n, ' '))) + len(list_distinct(string_split(m.name, ' '))))) END))"


@query(f"""WITH {_CATALOG}, {_MENTIONS}, sims AS (SELECT m.name, c.names, coalesce({_NAME_SQL}, 0) AS sim FROM (SELECT DISTINCT name FROM m) m CROSS JOIN (SELECT DISTINCT names FROM c) c),
x AS (SELECT m.id, coalesce(m.external = c.external, false) AS own, {' + '.join(f'{_BAD[a]}::INT' for a in resolve.HARD)} AS hard, {' + '.join(f'{_BAD[a]}::INT' for a in resolve.SOFT)} AS soft, c.target, c.concept, c.language AS lang, c.variant AS var, s.sim,
 {' + '.join(f'CASE WHEN {_OK[a]} THEN {resolve.POINTS[a]} WHEN {_BAD[a]} THEN {resolve.CONFLICT} ELSE 0 END' for a in _OK)} + CASE WHEN s.sim = 1 THEN 25 WHEN s.sim >= 0.78 THEN 15 * s.sim ELSE 0 END + CASE WHEN coalesce(m.content_language = c.language, false) THEN 8 ELSE 0 END + CASE WHEN m.context AND ({_OK['set_key']} OR {_OK['number']}) THEN 4 ELSE 0 END AS base,
 m.set_key IS NULL AND m.number IS NULL AND m.language IS NULL AND m.variant IS NULL AND m.external IS NULL AS nothing_hard
 FROM m JOIN c ON m.game IS NULL OR m.game = c.game JOIN sims s ON s.name IS NOT DISTINCT FROM m.name AND s.names = c.names),
y AS (SELECT *, base + CASE WHEN own AND hard + soft = 0 THEN 100 ELSE 0 END AS points, max(CASE WHEN hard = 0 THEN (sim >= 0.78)::INT ELSE 0 END) OVER (PARTITION BY id) AS narrowed FROM x WHERE hard = 0 OR own),
z AS (SELECT *, hard = 0 AND (sim >= 0.78)::INT = narrowed AND NOT (nothing_hard AND narrowed = 0) AS pooled FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY id, pooled AND soft = 0 ORDER BY points DESC, target) AS rank FROM z),
g AS (SELECT id, bool_or(own AND hard + soft > 0) AS clash, bool_or(own AND pooled AND hard + soft = 0) AS found, max(target) FILTER (WHERE own) AS own_target, max(concept) FILTER (WHERE own) AS own_concept, count(*) FILTER (WHERE pooled) AS n, count(DISTINCT concept) FILTER (WHERE pooled) = 1 AS one_concept, min(concept) FILTER (WHERE pooled) AS a_concept, count(DISTINCT lang) FILTER (WHERE pooled) > 1 AS languages, count(DISTINCT var) FILTER (WHERE pooled) > 1 AS variants,
 max(sim) FILTER (WHERE pooled) AS best, max(target) FILTER (WHERE pooled) AS any_target, max(points) FILTER (WHERE pooled) AS most, count(*) FILTER (WHERE pooled AND soft = 0) AS clean, {', '.join(f'max({v}) FILTER (WHERE pooled AND soft = 0 AND rank = {k}) AS {v}{k}' for v, k in (('sim', 1), ('target', 1), ('concept', 1), ('points', 1), ('points', 2)))} FROM r GROUP BY id),
s AS (SELECT m.id, g.* EXCLUDE (id), CASE WHEN clash THEN 'conflict' WHEN found THEN 'exact' WHEN coalesce(n, 0) = 0 THEN 'unresolved' WHEN nh AND one_concept AND best < 1 AND best >= 0.78 THEN 'probable' WHEN nh AND one_concept THEN 'ambiguous' WHEN m.language IS NULL AND languages THEN 'ambiguous' WHEN m.variant IS NULL AND variants THEN 'ambiguous'
 WHEN n = 1 AND whole THEN 'exact' WHEN n = 1 AND m.name IS NOT NULL AND best < 1 AND best >= 0.85 THEN 'high_confidence' WHEN n = 1 THEN 'exact' WHEN clean = 0 THEN 'unresolved' WHEN m.name IS NOT NULL AND sim1 < 1 AND sim1 >= 0.85 AND points1 - coalesce(points2, 0) >= 20 AND m.language IS NOT NULL AND m.variant IS NOT NULL AND NOT whole THEN 'high_confidence'
 WHEN sim1 >= 0.78 AND sim1 < 1 AND m.set_key IS NULL THEN 'probable' ELSE 'ambiguous' END AS status
 FROM (SELECT *, set_key IS NULL AND number IS NULL AND language IS NULL AND variant IS NULL AND external IS NULL AS nh, game IS NOT NULL AND set_key IS NOT NULL AND number IS NOT NULL AND language IS NOT NULL AND variant IS NOT NULL AS whole FROM m) m LEFT JOIN g ON g.id = m.id)
SELECT id, status, CASE WHEN status IN ('exact', 'high_confidence') THEN CASE WHEN found THEN own_target WHEN n = 1 THEN any_target ELSE target1 END END AS target,
 CASE WHEN clash OR found THEN own_concept WHEN status = 'probable' AND NOT one_concept THEN concept1 WHEN status = 'high_confidence' AND n > 1 THEN concept1 WHEN one_concept THEN a_concept END AS concept, round(coalesce(points1, most), 4) AS points, coalesce(n, 0) AS pool FROM s""")
def resolve_entity_status(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as the catalog and, with attributes left out, names misspelt and ids of others, as the mentions; SQL meets all pairs."""
    parts, k, name = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_name")
    language, other, variant = F.when(k % 2 == 0, "en").otherwise("ja"), F.concat(name, F.lit(" xl")), F.when(k % 11 < 2, "holo").otherwise("normal")
    catalog = parts.select(
        k.alias("target"), name.alias("concept"), F.when(k % 4 == 0, F.array(name, other)).otherwise(F.array(name)).alias("names"), F.col("p_type").alias("game"), F.col("p_brand").alias("set_key"), F.col("p_size").alias("number"), language.alias("language"), variant.alias("variant"),
        F.when(k % 5 == 1, "rare").when(k % 5 > 1, "common").alias("rarity"), F.when(k % 7 < 3, "matte").otherwise("gloss").alias("finish"), (k % 10 == 0).alias("promo"), F.concat(F.lit("x"), k).alias("external"),
    )
    wrong = F.when(k % 8 == 0, other).when(k % 9 == 1, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1000))).when(k % 29 == 1, F.concat(F.lit("nothing alike "), k)).otherwise(F.replace(name, F.lit("e"), F.when(k % 3 == 0, "a").otherwise("e")))
    mentions = parts.select(
        k.alias("id"), F.when(k % 19 != 0, wrong).alias("name"), F.when(k % 3 != 0, F.col("p_type")).alias("game"), F.when((k % 5 != 0) & (k % 7 != 3), F.col("p_brand")).alias("set_key"), F.when(k % 7 == 3, None).when(k % 17 == 0, -1).when(k % 4 != 0, F.col("p_size")).alias("number"), F.when(k % 6 >= 2, language).alias("language"), F.when(k % 4 == 1, variant).alias("variant"),
        F.when(k % 31 == 0, "rare").alias("rarity"), F.when(k % 23 == 0, "matte").alias("finish"), F.when(k % 37 == 0, True).alias("promo"), (k % 2 == 1).alias("context"), F.when(k % 13 == 0, F.concat(F.lit("x"), k)).when(k % 13 == 1, F.concat(F.lit("x"), k + 1)).when(k % 13 == 2, "none").alias("external"), F.when(k % 7 == 0, "ja").alias("content_language"),
    )
    return resolve.statuses(mentions, catalog).select("id", "status", "target", "concept", F.round("points", 4).alias("points"), "pool")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, metric_key, value, unit FROM (
SELECT l_orderkey, l_linenumber, l_partkey, 'price' AS metric_key, l_extendedprice / l_quantity AS value, 'USD' AS unit FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'quantity', l_quantity, 'units' FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'discount', l_discount, 'ratio' FROM lineitem WHERE l_discount > 0.05)""")
def kernel_unpivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    metrics = [("price", F.col("l_extendedprice") / F.nullif(quantity, F.lit(0.0)), "USD", (F.col("l_returnflag") == "N") & (quantity > 0)), ("quantity", quantity, "units", F.lit(True)), ("discount", discount, "ratio", discount > 0.05)]
    return ingest.unpivot_metrics(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], metrics)


@query("SELECT c_custkey AS id, 'ent_' || substring(sha256(c_custkey || '|' || c_name || '|' || c_mktsegment), 1, 32) AS stable_id, lower(c_mktsegment) || ':' || c_custkey AS canonical_key, lower(trim(regexp_replace('  ' || c_name || '  X ', '\\s+', ' ', 'g'))) AS name FROM customer".replace("\\\\", "\\"))
def kernel_stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), stable_id("ent_", F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("stable_id"), joined(F.lower("c_mktsegment"), F.col("c_custkey"), by=":").alias("canonical_key"), squeezed(F.concat(F.lit("  "), "c_name", F.lit("  X "))).alias("name"))


@query("SELECT 'entity' AS table_name, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'observation', count(*) FROM events UNION ALL SELECT 'metric', count(value) FROM events UNION ALL SELECT 'evidence', count(*) FROM events UNION ALL SELECT 'signal', count(*) FROM events")
def kernel_normalize_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each kernel table after normalising every event twice: a replay adds none, as ids follow from the event."""
    rows = events(spark, sf).select(F.lit(1).alias("organization"), F.col("id").alias("event_id"), "event_type", "at", F.col("instrument").alias("entity"), F.col("price").alias("value"))
    once, again = ingest.kernel_rows(rows), ingest.kernel_rows(rows)
    ids = {"entity": "entity_id", "observation": "observation_id", "metric": "metric_id", "evidence": "evidence_id", "signal": "signal_id"}
    out = None
    for name, key in ids.items():
        both = once[name].unionByName(again[name]).agg(F.countDistinct(key).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = both if out is None else out.unionByName(both)
    return out


_FP = "sha256(concat_ws('|', l_partkey, l_suppkey, l_quantity::INT))"


#: Line items as a feed: some arrive again as they are, some a second time at the same place, some changed; some have no key.
FEED = f"""f AS (SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 0 AS seq FROM lineitem),
g AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE l_suppkey % 10 = 0 UNION ALL SELECT * REPLACE (1 AS seq) FROM f WHERE l_partkey % 4 = 0 UNION ALL SELECT * REPLACE (2 AS seq, l_quantity + 1 AS l_quantity) FROM f WHERE l_partkey % 6 = 0 UNION ALL SELECT * REPLACE (3 AS seq) FROM f WHERE l_partkey % 12 = 0),
feed AS (SELECT *, {_FP} AS fp FROM g)"""


def feed(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf, "lineitem").select(F.when(c("l_orderkey") % 50 != 0, c("l_orderkey")).alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # 0: first arrival; 1: as it was; 2: changed; 3: as it was once more
    seqs = F.concat(F.when(c("l_suppkey") % 10 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))), *[F.when(c("l_partkey") % n == 0, F.array(F.lit(i))).otherwise(F.array().cast("array<int>")) for i, n in ((1, 4), (2, 6), (3, 12))])
    rows = rows.withColumn("seq", F.explode(seqs)).withColumn("l_quantity", F.when(c("seq") == 2, c("l_quantity") + 1).otherwise(c("l_quantity")))
    return rows.withColumn("fp", F.sha2(joined(c("l_partkey"), c("l_suppkey"), c("l_quantity").cast("int")), 256))


@query(f"""WITH {FEED}, n AS (SELECT *, row_number() OVER w AS r, first_value(fp) OVER w AS first FROM feed WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY seq, fp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seq, CASE WHEN r = 1 THEN 'new' WHEN fp = first THEN 'duplicate' ELSE 'conflict' END AS verdict FROM n""")
def ingest_dedup_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.dedup_conflicts(feed(spark, sf), ["l_orderkey", "l_linenumber"], "fp", ["seq"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seq", "verdict")


_CUR = "CASE (props->>'$.k')::BIGINT % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'usd' ELSE 'JPY' END"


@query(f"""WITH r AS (SELECT event_id AS id, value AS price, {_CUR} AS currency, CASE WHEN event_id % 13 = 0 THEN 'mint' ELSE 'nm' END AS condition, (props->>'$.k')::BIGINT - 2 AS quantity, ts FROM events)
SELECT id, CASE WHEN currency NOT IN ('USD', 'JPY', 'EUR') THEN 'currency' WHEN condition <> 'nm' THEN 'condition' WHEN price <= 0 THEN 'price' WHEN quantity < 0 THEN 'quantity' WHEN ts > {A} THEN 'observed_at' END AS reason,
(currency NOT IN ('USD', 'JPY', 'EUR'))::INT + (condition <> 'nm')::INT + (price <= 0)::INT + (quantity < 0)::INT + (ts > {A})::INT AS failures FROM r""")
def ingest_validate_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    rows = events(spark, sf).select("id", "price", F.when(k % 4 == 0, "USD").when(k % 4 == 1, "EUR").when(k % 4 == 2, "usd").otherwise("JPY").alias("currency"), F.when(F.col("id") % 13 == 0, "mint").otherwise("nm").alias("condition"), (k - 2).alias("quantity"), "at")
    c = F.col
    rules = ingest.market_rules(c("price"), c("currency"), c("condition"), c("quantity"), c("at"), instant(ASOF))
    marked = rows.withColumn("failures", F.size(ingest.failures(rules)))
    accepted, quarantined = relational.route(marked, ingest.first_failure(rules))
    return accepted.withColumn("reason", F.lit(None).cast("string")).select("id", "reason", "failures").unionByName(quarantined.select("id", "reason", "failures"))


_STATE = "CASE event_type WHEN 'signup' THEN 'trial' WHEN 'view' THEN 'activated' WHEN 'click' THEN 'at_risk' WHEN 'purchase' THEN 'customer' ELSE 'churned' END"
_EDGES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in accounts.LIFECYCLE.items() for b in to) + ") e(src, dst)"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "signup", "trial").when(kind == "view", "activated").when(kind == "click", "at_risk").when(kind == "purchase", "customer").otherwise("churned")
    return events(spark, sf).select("id", "at", F.col("instrument").alias("organization"), state.alias("state"))


@query(f"WITH s AS (SELECT event_id AS id, user_id AS organization, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) SELECT id, organization, previous, state FROM s WHERE previous IS NOT NULL AND previous <> state AND NOT EXISTS (SELECT 1 FROM {_EDGES_SQL} WHERE e.src = previous AND e.dst = state)")
def state_illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return relational.illegal_steps(_states(spark, sf), "organization", "state", accounts.edges(spark), ["at", "id"]).select("id", "organization", "previous", "state")


@query("""WITH e AS (SELECT user_id AS organization, event_type, ts FROM events WHERE ts <= TIMESTAMP '2024-01-02 00:00:00')
SELECT organization, bool_or(event_type = 'signup') AS created, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'signup') AND (bool_or(event_type = 'view') OR bool_or(event_type = 'purchase')) AS activated, epoch_us(min(ts) FILTER (WHERE event_type = 'signup')) AS first_signup FROM e GROUP BY organization""")
def crm_activation(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).where(F.col("at") <= instant("2024-01-02 00:00:00")).withColumnRenamed("instrument", "organization")
    kind = F.col("event_type")
    found = accounts.activation(rows, "organization", kind == "signup", {"viewed": kind == "view", "bought": kind == "purchase"})
    first = rows.where("event_type = 'signup'").groupBy("organization").agg(F.min("at").alias("first_signup"))
    return found.join(first, "organization", "left")


_BILLING = "CASE organization % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'past_due' WHEN 2 THEN 'canceled' WHEN 3 THEN 'trialing' ELSE 'none' END"
HEALTH = ("activation", "recent_activity", "api_usage", "errors", "webhook_health", "billing_health", "feature_adoption", "overall")


@query(f"""WITH e AS (SELECT user_id AS organization, bool_or(event_type = 'signup') AS created, bool_or(event_type = 'purchase') AND bool_or(event_type = 'signup') AS activated, count(*) FILTER (WHERE ts >= {A} - INTERVAL 14 DAY AND ts <= {A} AND event_type <> 'view') AS recent, coalesce(sum((props->>'$.k')::BIGINT) FILTER (WHERE event_type = 'signup'), 0)::BIGINT AS used,
 bool_or(event_type = 'error' AND (props->>'$.k')::BIGINT > 97) AS payment_failed, count(DISTINCT event_type) FILTER (WHERE event_type <> 'error' AND value > 150) AS adopted, CASE WHEN user_id % 7 = 0 THEN 0 ELSE 1000 END AS lim FROM events GROUP BY user_id),
w AS (SELECT o_custkey AS organization, count(*) AS endpoints, count(*) FILTER (WHERE o_orderstatus = 'F') AS failing FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
h AS (SELECT e.organization, CASE WHEN activated THEN 100 WHEN created THEN 40 ELSE 0 END AS activation, CASE WHEN recent = 0 THEN 20 ELSE least(100, 40 + recent * 15) END AS recent_activity, CASE WHEN lim <= 0 THEN CASE WHEN used > 0 THEN 70 ELSE 30 END WHEN used = 0 THEN 25 WHEN used >= lim THEN 55 ELSE floor(40 + 60 * (used / lim) + 0.5) END AS api_usage,
 CASE WHEN payment_failed THEN 35 ELSE 80 END AS errors, CASE WHEN coalesce(endpoints, 0) = 0 THEN 60 WHEN failing = 0 THEN 100 ELSE greatest(0, 100 - failing * 25) END AS webhook_health, CASE {_BILLING.replace("organization", "e.organization")} WHEN 'active' THEN 100 WHEN 'trialing' THEN 100 WHEN 'past_due' THEN 30 WHEN 'canceled' THEN 10 ELSE 50 END AS billing_health, least(100, adopted * 25) AS feature_adoption FROM e LEFT JOIN w ON w.organization = e.organization)
SELECT organization, {', '.join(f"{c}::INT AS {c}" for c in HEALTH[:-1])}, floor((activation + recent_activity + api_usage + errors + webhook_health + billing_health + feature_adoption) / 7.0::DOUBLE + 0.5)::INT AS overall FROM h""")
def crm_health(spark: SparkSession, sf: str) -> DataFrame:
    """Organisations are users of events, their webhook endpoints a fifth of their orders."""
    kind, c = F.col("event_type"), F.col
    recent = (c("at") >= instant(ASOF) - 14 * DAY) & (c("at") <= instant(ASOF)) & (kind != "view")
    found = events(spark, sf).groupBy(c("instrument").alias("organization")).agg(
        F.bool_or(kind == "signup").alias("created"), (F.bool_or(kind == "purchase") & F.bool_or(kind == "signup")).alias("activated"), F.count_if(recent).alias("recent"), F.coalesce(F.sum(F.when(kind == "signup", c("k"))), F.lit(0)).alias("used"),
        F.bool_or((kind == "error") & (c("k") > 97)).alias("payment_failed"), F.countDistinct(F.when((kind != "error") & (c("price") > 150), kind)).alias("adopted"),
    )
    hooks = claims(spark, sf).where("id % 5 = 0").groupBy(c("forecaster").alias("organization")).agg(F.count("*").alias("endpoints"), F.count_if(c("status") == "F").alias("failing"))
    rows = found.join(hooks, "organization", "left").fillna(0, ["endpoints", "failing"])
    i = c("organization") % 5
    billing = F.when(i == 0, "active").when(i == 1, "past_due").when(i == 2, "canceled").when(i == 3, "trialing").otherwise("none")
    limit = F.when(c("organization") % 7 == 0, 0).otherwise(1000)
    scores = accounts.health(c("activated"), c("created"), c("recent"), c("used"), limit, c("payment_failed"), c("endpoints"), c("failing"), billing, c("adopted"))
    return rows.select("organization", *[x.alias(k) for k, x in scores.items()])


SEGMENTS = {"builders": [("c_mktsegment", "eq", "BUILDING"), ("c_nationkey", "neq", 3)], "not_autos": [("c_mktsegment", "neq", "AUTOMOBILE")], "none": [], "broken": [("c_mktsegment", "like", "A%")]}


@query("SELECT 'builders' AS segment, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3 UNION ALL SELECT 'not_autos', c_custkey FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'")
def crm_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Memberships of all segments in one pass over the customers."""
    hits = F.array_compact(F.array(*[F.when(accounts.segment(r), name) for name, r in SEGMENTS.items()]))
    return table(spark, sf, "customer").select(F.explode(hits).alias("segment"), F.col("c_custkey").alias("id"))


_ORG = "o AS (SELECT c_custkey AS organization, CASE c_custkey % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'growth' WHEN 3 THEN 'scale' ELSE 'legacy' END AS plan, CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'past_due' ELSE 'trialing' END AS status FROM customer)"
_PLANS_SQL = "pl AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {r}, {d})" for p, r, d, _ in accounts.PLANS) + ") v(plan, requests, depth_days))"


def _organizations(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey")
    plan = F.when(i % 5 == 0, "free").when(i % 5 == 1, "starter").when(i % 5 == 2, "growth").when(i % 5 == 3, "scale").otherwise("legacy")
    return table(spark, sf, "customer").select(i.alias("organization"), plan.alias("plan"), F.when(i % 3 == 0, "active").when(i % 3 == 1, "past_due").otherwise("trialing").alias("status"))


@query(f"""WITH {_ORG}, {_PLANS_SQL}, u AS (SELECT o_custkey AS organization, sum(o_totalprice)::BIGINT // 100 AS used FROM orders GROUP BY 1), e AS (SELECT *, CASE WHEN status IN ('active', 'trialing') AND plan IN ('free', 'starter', 'growth', 'scale') THEN plan ELSE 'free' END AS effective_plan FROM o)
SELECT e.organization, effective_plan, CASE WHEN e.organization % 10 = 0 THEN 5000 ELSE requests END AS requests, depth_days, coalesce(used, 0) >= CASE WHEN e.organization % 10 = 0 THEN 5000 ELSE requests END AS exceeded, greatest(CASE WHEN e.organization % 10 = 0 THEN 5000 ELSE requests END - coalesce(used, 0), 0)::BIGINT AS remaining FROM e JOIN pl ON pl.plan = e.effective_plan LEFT JOIN u ON u.organization = e.organization""")
def quota_entitlements(spark: SparkSession, sf: str) -> DataFrame:
    rows = _organizations(spark, sf)
    overrides = rows.where("organization % 10 = 0").select("organization", F.lit(5000).cast("long").alias("requests"))
    used = accounts.used_units(claims(spark, sf).select(F.col("forecaster").alias("organization"), "price"), "organization", "price")
    found = accounts.entitled(rows, accounts.plans(spark), overrides).join(used, "organization", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    q = accounts.quota(F.col("used"), F.col("requests"))
    return found.select("organization", "effective_plan", "requests", "depth_days", q["exceeded"].alias("exceeded"), q["remaining"].alias("remaining"))


@query("""WITH u AS (SELECT user_id AS organization, epoch_us(date_trunc('month', ts)) AS month, sum((props->>'$.k')::BIGINT)::BIGINT AS used FROM events WHERE event_type = 'signup' GROUP BY ALL), t AS (SELECT u.*, 700 AS lim, threshold FROM u, (VALUES (50), (80), (90), (100)) v(threshold))
SELECT organization, month, threshold, CASE WHEN threshold >= 100 THEN 'critical' WHEN threshold >= 90 THEN 'warning' ELSE 'info' END AS severity FROM t WHERE 100 * used >= threshold * lim AND NOT (organization % 2 = 0 AND threshold = 50)""")
def usage_warnings_once(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds crossed in a month; even organisations were warned at 50 before."""
    month = F.unix_micros(F.date_trunc("month", F.timestamp_micros("at")))
    usage = events(spark, sf, "signup").groupBy(F.col("instrument").alias("organization"), month.alias("month")).agg(F.sum("k").alias("used")).withColumn("limit", F.lit(700))
    emitted = usage.where("organization % 2 = 0").select("organization", "month", F.lit(50).alias("threshold"))
    return accounts.warnings_due(usage, emitted)


@query("""WITH e AS (SELECT event_id AS id, user_id AS endpoint, ts, (props->>'$.k')::BIGINT % 9 + 1 AS attempt, CASE (props->>'$.k')::BIGINT % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 500 WHEN 4 THEN 408 ELSE 503 END AS http FROM events WHERE event_type = 'error'),
r AS (SELECT *, sum(CASE WHEN http = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY ts, id) AS run FROM e), s AS (SELECT *, sum((http <> 200)::INT) OVER (PARTITION BY endpoint, run ORDER BY ts, id) AS streak FROM r)
SELECT id, endpoint, streak::BIGINT AS streak, CASE WHEN http = 200 THEN 'delivered' WHEN http = 404 OR attempt >= 8 THEN 'dead' ELSE 'pending' END AS status, CASE WHEN http <> 200 AND http <> 404 AND attempt < 8 THEN least(60 * pow(2, attempt - 1), 86400)::BIGINT END AS delay_s, streak >= 8 AS disabled FROM s""")
def webhook_retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k") % 6
    rows = events(spark, sf, "error").select("id", "at", F.col("instrument").alias("endpoint"), (F.col("k") % 9 + 1).alias("attempt"), F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 429).when(k == 3, 500).when(k == 4, 408).otherwise(503).alias("http"))
    stepped = relational.consecutive_failures(rows, "endpoint", F.col("http") != 200, ["at", "id"])
    return stepped.select("id", "endpoint", "streak", *[c.alias(n) for n, c in accounts.retry(F.col("attempt"), F.col("http"), F.col("streak")).items()])


@query("SELECT p_partkey AS id, NOT (p_partkey % 19 <> 0) OR NOT (p_size > 5 OR p_retailprice > 1500) OR p_type = 'PROMO' OR p_size % 4 < 2 OR p_size % 3 < 1 OR p_partkey % 5 = 0 AS thin FROM part")
def content_thin_evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    thin = accounts.thin_evidence(key % 19 != 0, size > 5, F.col("p_retailprice") > 1500, F.when(F.col("p_type") == "PROMO", "insufficient_data").otherwise("buy"), size % 4, size % 3, key % 5, 2, 1)
    return table(spark, sf, "part").select(key.alias("id"), thin.alias("thin"))


@query("""WITH p AS (SELECT c_custkey AS user_id, category, channel FROM customer, (VALUES ('account'), ('billing'), ('usage'), ('security'), ('product'), ('marketing')) a(category), (VALUES ('email'), ('in_app'), ('webhook')) b(channel))
SELECT user_id AS "user", category, channel, CASE WHEN category IN ('account', 'security') AND channel <> 'webhook' THEN true WHEN user_id % 3 = 0 AND category = 'usage' THEN channel = 'webhook' WHEN category = 'marketing' THEN false WHEN category IN ('account', 'security', 'billing', 'usage') THEN channel <> 'webhook' ELSE channel = 'in_app' END AS opted_in FROM p""")
def prefs_default_cross_product(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"))
    channels = F.array(*[F.lit(c) for c in accounts.CHANNELS])
    stored = users.where("user % 3 = 0").select("user", F.lit("usage").alias("category"), F.explode(channels).alias("channel")).withColumn("opted_in", F.col("channel") == "webhook")
    return accounts.preferences(users, stored)


@query("SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'invalid' WHEN ts < TIMESTAMP '2024-01-10' THEN 'expired' WHEN (props->>'$.k')::BIGINT > 80 THEN 'exhausted' WHEN event_id % 3 = 0 THEN 'email_mismatch' ELSE 'accepted' END AS outcome FROM events WHERE event_type = 'signup'")
def invite_outcome(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    return events(spark, sf, "signup").select("id", accounts.invite(i % 7 != 0, F.col("at"), F.col("k"), F.lit(81), i % 3 != 0, instant("2024-01-10 00:00:00") - 1).alias("outcome"))


@query(f"SELECT user_id AS organization, count(*) AS n FROM events WHERE event_type = 'view' AND user_id IN (1, 2, 3, 5, 8) AND {_in(7)} GROUP BY 1")
def filter_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    where = relational.conjunction(event_type="view", instrument=[1, 2, 3, 5, 8], price=relational.UNSET)
    return events(spark, sf).where(where & trailing(F.col("at"), instant(ASOF), 7)).groupBy(F.col("instrument").alias("organization")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, user_id AS organization FROM events WHERE user_id = 7 AND (value > 100 OR props IS NULL)")
def filter_tenant(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumnRenamed("instrument", "organization")
    return relational.for_tenant(rows, 7).where((F.col("price") > 100) | F.col("k").isNull()).select("id", "organization")


_UP = "a AS (SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS d FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = claims(spark, sf).select(F.col("forecaster").alias("k"), F.col("id").alias("v"), F.struct("at", "id").alias("o"))
    cut = F.col("o.at") < instant("1998-01-01 00:00:00")
    return rows.where(cut), rows.where(~cut)


@query(f"WITH {_UP}, x AS (SELECT k, arg_max(v, (d, v)) AS v FROM b GROUP BY k), y AS (SELECT k, arg_max(v, (d, v)) AS v FROM a GROUP BY k) SELECT coalesce(x.k, y.k) AS k, coalesce(x.v, y.v) AS v FROM y FULL JOIN x ON x.k = y.k")
def sink_upsert(spark: SparkSession, sf: str) -> DataFrame:
    existing, new = _halves(spark, sf)
    return relational.upsert(existing, new, ["k"], "o").select("k", "v")


@query(f"WITH {_UP} SELECT k, arg_min(v, (d, v)) AS v FROM b WHERE k NOT IN (SELECT k FROM a WHERE v % 3 = 0) GROUP BY k")
def sink_insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    existing, new = _halves(spark, sf)
    return relational.insert_absent(existing.where("v % 3 = 0"), new, ["k"], ["o"]).select("k", "v")


@query("WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 100 END AS e FROM customer) SELECT k, CASE WHEN e IS NULL AND k % 3 = 0 THEN 500 ELSE e END AS effective_to FROM c")
def sink_close_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, 100).alias("effective_to"))
    return relational.close_intervals(rows, rows.where("k % 3 = 0"), ["k"], F.lit(500)).select("k", "effective_to")


@query("SELECT n_name AS nation, 'inner' AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'semi', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1 UNION ALL SELECT n_name, 'anti', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 1")
def join_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sides = {"inner": people, "semi": people.join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_semi"), "anti": people.join(orders.where("o_totalprice > 400000"), "c_custkey", "left_anti")}
    out = None
    for kind, rows in sides.items():
        part = rows.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("n")).select("nation", F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def window_latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), micros(F.col("o_orderdate")).alias("at"))
    return relational.latest_by_key(rows, ["k"], ["at", "id"]).select("k", "id", "price")


@query("SELECT o_custkey AS k, rank::INT AS rank, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def window_rank_first_n(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("rank", rank).where("rank <= 3").select(F.col("o_custkey").alias("k"), "rank", F.col("o_orderkey").alias("id"))
