"""Index, claim, authority, score and forecast queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import authority_score, authority_weight, beta_mean, price_tier, shrink, trust_state, wilson_high, wilson_low
from ..functions.times import DAY, instant, micros
from ..operators import claims as claim_ops
from ..operators import authority, features, forecast, indices, pit, scoring, series, windows
from ..session import materialised
from ..sources.tables import claims, daily_trades, events, quotes, table, trades
from .catalog import ASOF, DAILY, LONG_ASOF, QUOTES, TRADES, query
from .features import A, VECTOR, _in, event_features

# indices over line items -----------------------------------------------------------------------------

KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
DEFINITIONS = [(f"kind.{k}", k, None, 1, 3, "equal" if i % 2 else "liquidity", False) for i, k in enumerate(KINDS)] + [(f"brand.{b}.{k}", k, f"Brand#{b}", 1, 2, "liquidity", False) for b in range(1, 7) for k in KINDS[:3]] + [("all", None, None, 5, 5, "equal", False), ("all.mixed", None, None, 5, 30, "liquidity", True)]
WINDOW_DAYS = 90
STEPS = ("1999-06-30", "1999-12-31", "2000-06-30", "2000-12-31")


def _lit(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


DEFS_SQL = "defs AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_lit(x) for x in d) + ")" for d in DEFINITIONS) + ") v(index_key, kind, brand, min_sales, min_history, method, mixed))"


def _members_sql(asof: str, name: str) -> str:
    return f"""c_{name} AS (SELECT instrument, count(*) FILTER (WHERE ts > TIMESTAMP '{asof}' - INTERVAL {WINDOW_DAYS} DAY) AS sales, count(*) AS history FROM l WHERE ts <= TIMESTAMP '{asof}' GROUP BY 1),
m_{name} AS (SELECT index_key, p_partkey AS instrument, sales, method FROM defs JOIN part ON (kind IS NULL OR kind = p_type) AND (brand IS NULL OR brand = p_brand) AND (kind IS NOT NULL OR mixed) JOIN c_{name} c ON c.instrument = p_partkey WHERE sales >= min_sales AND history >= min_history),
w_{name} AS (SELECT *, round(CASE WHEN method = 'liquidity' AND sum(sales) OVER (PARTITION BY index_key) > 0 THEN sales / sum(sales) OVER (PARTITION BY index_key) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY index_key) END, 8) AS weight FROM m_{name})"""


def _definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFINITIONS, indices.DEFINITION)


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("instrument"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))


def _members(spark: SparkSession, sf: str, asof: str) -> DataFrame:
    at = instant(asof)
    counts = daily_trades(spark, sf).where(F.col("at") <= at).groupBy("instrument").agg(F.count_if(F.col("at") > at - WINDOW_DAYS * DAY).alias("sales"), F.count("*").alias("history"))
    return indices.qualify(_definitions(spark), _parts(spark, sf), counts)


@query(f"WITH {DAILY}, {DEFS_SQL}, {_members_sql(LONG_ASOF, 'a')} SELECT index_key, instrument, sales FROM m_a")
def index_qualify_members(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf, LONG_ASOF).select("index_key", "instrument", "sales")


@query(f"WITH {DAILY}, {DEFS_SQL}, {_members_sql(LONG_ASOF, 'a')} SELECT index_key, instrument, weight FROM w_a WHERE method = 'equal'")
def index_weights_equal(spark: SparkSession, sf: str) -> DataFrame:
    return indices.weights(_members(spark, sf, LONG_ASOF).where("method = 'equal'")).select("index_key", "instrument", "weight")


@query(f"WITH {DAILY}, {DEFS_SQL}, {_members_sql(LONG_ASOF, 'a')} SELECT index_key, instrument, weight FROM w_a WHERE method = 'liquidity'")
def index_weights_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    return indices.weights(_members(spark, sf, LONG_ASOF).where("method = 'liquidity'")).select("index_key", "instrument", "weight")


@query(f"WITH {DAILY}, {DEFS_SQL}, {_members_sql(STEPS[1], 'a')}, {_members_sql(STEPS[2], 'b')} SELECT index_key, instrument, CASE WHEN b.sales IS NULL THEN 'left' WHEN a.sales IS NULL THEN 'joined' ELSE 'stayed' END AS change FROM m_a a FULL JOIN m_b b USING (index_key, instrument)")
def index_rebalance_diff(spark: SparkSession, sf: str) -> DataFrame:
    return indices.rebalance_diff(_members(spark, sf, STEPS[1]), _members(spark, sf, STEPS[2]))


_STEPS_SQL = f"WITH {DAILY}, {DEFS_SQL}, " + ", ".join(_members_sql(d, f"s{i}") for i, d in enumerate(STEPS)) + ", dated AS (" + " UNION ALL ".join(f"SELECT index_key, instrument, weight, {i} AS step, TIMESTAMP '{d}' AS d FROM w_s{i}" for i, d in enumerate(STEPS)) + ")"
_TIMELINE_SQL = f"""{_STEPS_SQL}, g AS (SELECT *, step - row_number() OVER (PARTITION BY index_key, instrument ORDER BY step) AS run FROM dated), dt AS (SELECT * FROM (VALUES {', '.join(f"({i}, TIMESTAMP '{d}')" for i, d in enumerate(STEPS))}) v(step, d)),
iv AS (SELECT index_key, instrument, arg_min(weight, g.step) AS weight, min(g.d) AS f, max(g.step) + 1 AS nx FROM g GROUP BY index_key, instrument, run),
timeline AS (SELECT index_key, instrument, weight, f, dt.d AS e FROM iv LEFT JOIN dt ON dt.step = iv.nx)"""


def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Memberships over all rebalance dates, which one pass over the trades counts together."""
    at = F.col("at")
    each = [F.struct(F.lit(i).alias("step"), F.count_if((at <= instant(d)) & (at > instant(d) - WINDOW_DAYS * DAY)).alias("sales"), F.count_if(at <= instant(d)).alias("history")) for i, d in enumerate(STEPS)]
    counts = daily_trades(spark, sf).groupBy("instrument").agg(F.array(*each).alias("_steps")).select("instrument", F.explode("_steps").alias("_s")).select("instrument", "_s.*").where("history > 0")
    members = indices.qualify(_definitions(spark), _parts(spark, sf), counts)
    dated = indices.weights(members, ("index_key", "step")).select("index_key", "instrument", "weight", "step")
    dates = spark.createDataFrame([(i, d) for i, d in enumerate(STEPS)], "step int, d string").select("step", F.unix_micros(F.col("d").cast("timestamp")).alias("at"))
    return indices.timeline(dated, dates)


@query(f"{_TIMELINE_SQL} SELECT index_key, instrument, weight, epoch_us(f) AS effective_from, epoch_us(e) AS effective_to FROM timeline")
def index_rebalance_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline(spark, sf)


@query(f"{_TIMELINE_SQL} SELECT index_key, epoch_us(min(f)) AS inception, count(DISTINCT instrument) AS instruments FROM timeline GROUP BY 1")
def index_inception(spark: SparkSession, sf: str) -> DataFrame:
    """When each index had its first member, and how many instruments it has held."""
    return indices.inception(_timeline(spark, sf))


def _level_sql(asof: str, n: str) -> str:
    return f"""lm_{n} AS (SELECT index_key, weight, b.price AS base, c.price AS cur FROM timeline t ASOF LEFT JOIN l b ON t.instrument = b.instrument AND t.f >= b.ts LEFT JOIN (SELECT instrument, arg_max(price, ts) AS price FROM l WHERE ts <= TIMESTAMP '{asof}' GROUP BY 1) c ON c.instrument = t.instrument WHERE t.f <= TIMESTAMP '{asof}' AND (t.e IS NULL OR t.e > TIMESTAMP '{asof}')),
lv_{n} AS (SELECT index_key, count(*) AS members, count(*) FILTER (WHERE base > 0 AND cur IS NOT NULL) AS priced, coalesce(100 * sum(weight * cur / base) FILTER (WHERE base > 0 AND cur IS NOT NULL) / sum(weight) FILTER (WHERE base > 0 AND cur IS NOT NULL), 100) AS level FROM lm_{n} GROUP BY 1)"""


def _levels(spark: SparkSession, sf: str, asofs: tuple[str, ...], memberships: DataFrame) -> DataFrame:
    """Levels of each index at each of asofs. Members join at rebalance dates, so that one pass over the trades has all prices of all dates."""
    dates = sorted({*STEPS, *asofs})
    place = {d: i for i, d in enumerate(dates)}
    prices = pit.latest_at(daily_trades(spark, sf), "instrument", [instant(d) for d in dates], "price").select("instrument", "values")
    priced = memberships.join(prices, "instrument", "left").withColumn("base", F.coalesce(*[F.when(F.col("effective_from") == instant(d), F.get("values", F.lit(place[d]))) for d in STEPS]))
    each = F.array(*[F.struct(F.lit(d).alias("asof"), F.get("values", F.lit(place[d])).alias("current"), instant(d).alias("_t")) for d in asofs])
    active = pit.valid_at(priced.select("index_key", "weight", "base", "effective_from", "effective_to", F.explode(each).alias("_e")).select("*", "_e.*"), F.col("_t"))
    return indices.level(active, ("index_key", "asof"))


@query(f"{_TIMELINE_SQL}, {_level_sql('2000-09-30', 'a')} SELECT index_key, members, priced, round(level, 6) AS level, round(priced / members, 6) AS coverage, CASE WHEN priced = 0 THEN 'insufficient_data' WHEN priced / members >= 0.8 THEN 'complete' ELSE 'partial' END AS quality FROM lv_a")
def index_level_base100(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf, ("2000-09-30",), _timeline(spark, sf)).drop("asof").withColumns({"level": F.round("level", 6), "coverage": F.round("coverage", 6)})


@query(f"{_TIMELINE_SQL}, {_level_sql('2000-03-31', 'a')}, {_level_sql('2000-09-30', 'b')} SELECT index_key, round(b.level / a.level - 1, 6) AS index_return FROM lv_a a JOIN lv_b b USING (index_key)")
def index_return(spark: SparkSession, sf: str) -> DataFrame:
    levels = _levels(spark, sf, ("2000-03-31", "2000-09-30"), _timeline(spark, sf))
    at = lambda d: F.max(F.when(F.col("asof") == d, F.col("level")))
    both = levels.groupBy("index_key").agg(at("2000-03-31").alias("start"), at("2000-09-30").alias("end")).where("start is not null and end is not null")
    return both.select("index_key", F.round(indices.simple_return(F.col("start"), F.col("end")), 6).alias("index_return"))


@query(f"""WITH {DAILY}, {DEFS_SQL}, {_members_sql(LONG_ASOF, 'a')}, ok AS (SELECT index_key, count(*) AS n FROM m_a GROUP BY 1 HAVING count(*) >= 5),
cand AS (SELECT p_partkey AS instrument, 1 AS prio, 'brand.' || replace(p_brand, 'Brand#', '') || '.' || p_type AS index_key FROM part UNION ALL SELECT p_partkey, 2, 'kind.' || p_type FROM part UNION ALL SELECT p_partkey, 3, 'all.mixed' FROM part)
SELECT p_partkey AS instrument, arg_min(ok.index_key, prio) AS index_key, min(prio) FILTER (WHERE ok.index_key IS NOT NULL) AS prio FROM part LEFT JOIN cand ON cand.instrument = p_partkey LEFT JOIN ok USING (index_key) GROUP BY 1""")
def index_benchmark_resolve(spark: SparkSession, sf: str) -> DataFrame:
    ok = _members(spark, sf, LONG_ASOF).groupBy("index_key").agg(F.count("*").alias("n")).where("n >= 5")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("instrument"), "p_brand", "p_type")
    keys = F.array(F.concat(F.lit("brand."), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("."), "p_type"), F.concat(F.lit("kind."), "p_type"), F.lit("all.mixed"))
    candidates = parts.select("instrument", F.posexplode(keys).alias("p", "index_key")).join(ok, "index_key").select("instrument", "index_key", (F.col("p") + 1).alias("prio"))
    return indices.first_match(parts.select("instrument"), candidates, "instrument")


# claims ----------------------------------------------------------------------------------------------

SENTENCES = [
    (1, "I would buy this now, target $100 in 30 days"), (2, "overpriced, sell now"), (3, "stay away from it for a week"), (4, "keep an eye on it"), (5, "i pulled a great one, buy"), (6, "price is $40 today"),
    (7, "Undervalued! 25% upside within 6 months, 80% sure"), (8, "going down 10 % in two weeks"), (9, "nothing to say"), (10, "buy, hold 45 days"), (11, "TARGET 55.5 within a year, 120% confident"), (12, "will drop; watch it"), (13, ""), (14, "just a pull"), (15, "upbuying and reselling words are no calls"), (16, "avoid. 1 month"), (17, "これは上がる 90d"), (18, "売る $12"),
    (19, "buy, hold 99999999999 days"), (20, "buy, hold 4000 days"), (21, "hold 0000000000000045 days, target $" + "9" * 400), (22, "sell, " + "1" * 60 + " days, " + "7" * 50 + "% sure"),
]
SENTENCES_SQL = "s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SENTENCES) + ") v(id, text) UNION ALL SELECT 1000 + 100 * conv_id + turn, text FROM conversations)"


def _any(phrases: tuple[str, ...]) -> str:
    return f"regexp_matches(text, '{claim_ops.any_of(phrases)}')"


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of all conversations, and some sentences that state claims."""
    said = table(spark, sf, "conversations").select((1000 + 100 * F.col("conv_id") + F.col("turn")).alias("id"), "text")
    return spark.createDataFrame(SENTENCES, "id long, text string").unionByName(said)


@query(f"WITH {SENTENCES_SQL} SELECT id, CASE WHEN {_any(claim_ops.NON_CLAIM)} THEN NULL WHEN {_any(claim_ops.BULLISH)} THEN 'bullish' WHEN {_any(claim_ops.BEARISH)} THEN 'bearish' WHEN {_any(claim_ops.AVOID)} THEN 'avoid' WHEN {_any(claim_ops.WATCH)} THEN 'watch' END AS direction FROM s")
def claim_extract_direction(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).select("id", claim_ops.direction(F.col("text")).alias("direction"))


_HORIZON = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{c}'" for c, p in claim_ops.HORIZONS.items()) + " ELSE 'unspecified' END"


@query(rf"""WITH {SENTENCES_SQL}, h AS (SELECT *, {_HORIZON} AS horizon FROM s)
SELECT id, horizon, CASE WHEN horizon = 'custom' THEN CASE WHEN regexp_matches(text, '(?i)\b(\d+)\s*days?\b') THEN (SELECT CASE WHEN n <= 3650 THEN n::INT END FROM (SELECT try_cast(regexp_extract(text, '(?i)\b(\d+)\s*days?\b', 1) AS HUGEINT) AS n)) WHEN regexp_matches(text, '(?i)two weeks') THEN 14 END WHEN horizon <> 'unspecified' THEN regexp_extract(horizon, '(\d+)', 1)::INT END AS days,
coalesce(nullif(regexp_extract(text, '(?i)target\s*\$?\s*([0-9]+(?:\.[0-9]+)?)', 1), '')::DOUBLE, nullif(regexp_extract(text, '\$\s*([0-9]+(?:\.[0-9]+)?)', 1), '')::DOUBLE) AS target_price, nullif(regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)\s*%', 1), '')::DOUBLE AS target_percent,
CASE WHEN nullif(regexp_extract(text, '(?i)\b([0-9]{{1,3}})\s*%\s*(?:sure|confident)', 1), '')::DOUBLE / 100 <= 1 THEN nullif(regexp_extract(text, '(?i)\b([0-9]{{1,3}})\s*%\s*(?:sure|confident)', 1), '')::DOUBLE / 100 END AS confidence FROM h""")
def claim_extract_horizon_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = sentences(spark, sf).withColumn("horizon", claim_ops.horizon(F.col("text")))
    text = F.col("text")
    return rows.select("id", "horizon", claim_ops.horizon_days(text, F.col("horizon")).alias("days"), claim_ops.target_price(text).alias("target_price"), claim_ops.target_percent(text).alias("target_percent"), claim_ops.stated_confidence(text).alias("confidence"))


_CLAIMS_SQL = f"""{TRADES}, c0 AS (SELECT event_id AS id, ts, user_id AS instrument, CASE (props->>'$.k')::BIGINT % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'watch' END AS direction, CASE WHEN (props->>'$.k')::BIGINT % 5 = 0 THEN NULL ELSE 7 END AS days, value * 2 AS target_price FROM events WHERE event_type = 'click'),
c AS (SELECT c0.*, t.price AS start_price FROM c0 ASOF LEFT JOIN t ON t.instrument = c0.instrument AND c0.ts >= t.ts),
o0 AS (SELECT c.id, c.instrument, c.ts, c.direction, c.days, c.target_price, c.start_price, arg_max(t.price, (t.ts, t.id)) AS ending_price, max(t.price) AS hi, min(t.price) AS lo FROM c LEFT JOIN t ON t.instrument = c.instrument AND t.ts > c.ts AND t.ts <= c.ts + INTERVAL 7 DAY AND c.days IS NOT NULL GROUP BY ALL),
o1 AS (SELECT *, CASE WHEN start_price IS NULL OR days IS NULL THEN 'insufficient_data' WHEN ts + INTERVAL 7 DAY > {A} THEN 'pending' WHEN ending_price IS NULL THEN 'missing_market_data' ELSE 'evaluated' END AS status FROM o0),
o AS (SELECT *, CASE WHEN status = 'evaluated' THEN (ending_price - start_price) / nullif(start_price, 0) END AS ret, CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 END AS sgn FROM o1)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    clicks = events(spark, sf, "click")
    made = clicks.select("id", "at", "instrument", F.when(F.col("k") % 3 == 0, "bullish").when(F.col("k") % 3 == 1, "bearish").otherwise("watch").alias("direction"), F.when(F.col("k") % 5 != 0, 7).alias("days"), (F.col("price") * 2).alias("target_price"))
    return pit.asof_join(made, trades(spark, sf), "instrument", ["price"]).withColumnRenamed("asof_price", "start_price")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return claim_ops.outcome(_claims(spark, sf), trades(spark, sf), instant(ASOF))


@query(f"""WITH {_CLAIMS_SQL} SELECT id, status, round(ret, 6) AS ret, CASE WHEN status <> 'evaluated' THEN NULL WHEN sgn IS NULL THEN 'not_applicable' WHEN sgn * ret > 0.005 THEN 'correct' WHEN sgn * ret < -0.005 THEN 'incorrect' ELSE 'flat' END AS verdict,
CASE WHEN status = 'evaluated' AND sgn = 1 THEN ending_price >= target_price WHEN status = 'evaluated' AND sgn = -1 THEN ending_price <= target_price END AS target_hit, round(CASE WHEN status = 'evaluated' THEN greatest((hi - start_price) / nullif(start_price, 0), 0) END, 6) AS mfe, round(CASE WHEN status = 'evaluated' THEN least((lo - start_price) / nullif(start_price, 0), 0) END, 6) AS mae FROM o""")
def claim_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).select("id", "status", F.round("ret", 6).alias("ret"), "verdict", "target_hit", F.round("mfe", 6).alias("mfe"), F.round("mae", 6).alias("mae"))


@query(f"""WITH {_CLAIMS_SQL}, dc AS (SELECT instrument % 2 AS index_key, instrument, date_trunc('day', ts) AS d, arg_max(price, (ts, id)) AS close FROM t GROUP BY ALL), lv AS (SELECT index_key, d + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS ts, avg(close) AS level FROM dc GROUP BY ALL),
s AS (SELECT o.*, a.level AS l0 FROM o ASOF LEFT JOIN lv a ON o.instrument % 2 = a.index_key AND o.ts >= a.ts), e AS (SELECT s.*, b.level AS l1 FROM (SELECT *, ts + INTERVAL 7 DAY AS te FROM s) s ASOF LEFT JOIN lv b ON s.instrument % 2 = b.index_key AND s.te >= b.ts)
SELECT id, CASE WHEN status <> 'evaluated' THEN 'insufficient_outcome' WHEN l0 IS NULL OR l1 IS NULL OR l0 <= 0 THEN 'insufficient_benchmark' ELSE 'ok' END AS alpha_status, round(CASE WHEN status = 'evaluated' AND l0 > 0 THEN ret - (l1 / l0 - 1) END, 6) AS alpha FROM e""")
def claim_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Return in excess of the index of the claim's group, as its level stood at the claim and at its horizon."""
    group = (F.col("instrument") % 2).cast("long")
    levels = indices.market_levels(trades(spark, sf), group).withColumnRenamed("index_key", "g")
    rows = _outcomes(spark, sf).withColumn("g", group)
    at_claim = pit.asof_join(rows, levels, "g", ["level"], "start_", chunk=DAY)
    at_end = pit.asof_join(at_claim.withColumn("at", F.col("at") + 7 * DAY), levels, "g", ["level"], "end_", chunk=DAY)
    bench = indices.simple_return(F.col("start_level"), F.col("end_level"))
    status = F.when(F.col("status") != "evaluated", "insufficient_outcome").when(bench.isNull(), "insufficient_benchmark").otherwise("ok")
    return at_end.select("id", status.alias("alpha_status"), F.round(F.when(F.col("status") == "evaluated", F.col("ret") - bench), 6).alias("alpha"))


@query(f"""WITH {_CLAIMS_SQL}, f AS (SELECT o.id, o.ret, o.start_price, arg_min(t.price, (t.ts, t.id)) AS first FROM o LEFT JOIN t ON t.instrument = o.instrument AND t.ts > o.ts - INTERVAL 7 DAY AND t.ts <= o.ts GROUP BY ALL)
SELECT id, round(CASE WHEN first > 0 THEN (start_price - first) / first END, 6) AS pre_move, round(ret - CASE WHEN first > 0 THEN (start_price - first) / first END, 6) AS early FROM f""")
def claim_early_score(spark: SparkSession, sf: str) -> DataFrame:
    return claim_ops.early_score(_outcomes(spark, sf), trades(spark, sf)).select("id", F.round("pre_move", 6).alias("pre_move"), F.round("early", 6).alias("early"))


# authority -------------------------------------------------------------------------------------------

_N = "a AS (SELECT o_custkey AS forecaster, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k, avg(CASE WHEN o_orderstatus IN ('F', 'O') THEN (o_totalprice - 250000) / 500000 END) AS mean_return FROM orders GROUP BY 1)"
_W = "w AS (SELECT *, CASE WHEN n > 0 THEN greatest(least((k / n + 1.96 * 1.96 / (2.0 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 1), 0) ELSE 0 END AS low, CASE WHEN n > 0 THEN greatest(least((k / n + 1.96 * 1.96 / (2.0 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 1), 0) ELSE 1 END AS high FROM a)"


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    settled = F.col("status").isin("F", "O")
    return claims(spark, sf).groupBy("forecaster").agg(F.count_if(settled).alias("n"), F.count_if(F.col("status") == "F").alias("k"), F.avg(F.when(settled, (F.col("price") - 250000) / 500000)).alias("mean_return"))


@query(f"WITH {_N}, {_W} SELECT forecaster, n, k, round(low, 6) AS wilson_low, round(high, 6) AS wilson_high, round((k + 8) / (n + 16), 6) AS bayes_mean, round(n / (n + 20), 6) AS shrinkage FROM w")
def authority_wilson_bayes(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    return _sample(spark, sf).select("forecaster", "n", "k", F.round(wilson_low(k, n), 6).alias("wilson_low"), F.round(wilson_high(k, n), 6).alias("wilson_high"), F.round(beta_mean(k, n), 6).alias("bayes_mean"), F.round(shrink(n), 6).alias("shrinkage"))


@query(f"""WITH {_N}, {_W}, s AS (SELECT *, CASE WHEN forecaster % 97 = 0 THEN 'excluded' WHEN n < 5 THEN 'low_confidence' WHEN low < 0.35 AND n >= 8 THEN 'unreliable' WHEN n < 20 THEN 'developing' WHEN n >= 50 AND low >= 0.62 THEN 'trusted' WHEN low >= 0.5 THEN 'reliable' ELSE 'developing' END AS state FROM w)
SELECT forecaster, state, round(least(greatest(100 * (0.85 * low + 0.15 * (0.5 + coalesce(least(greatest(mean_return, -0.5), 0.5), 0))) * n / (n + 20), 0), 100), 4) AS score, round(CASE state WHEN 'excluded' THEN 0 WHEN 'unreliable' THEN 0.05 * n / (n + 20) ELSE n / (n + 20) * CASE state WHEN 'trusted' THEN 1 WHEN 'reliable' THEN 0.8 WHEN 'developing' THEN 0.45 ELSE 0.2 END * low END, 6) AS weight FROM s""")
def authority_trust_weight(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sample(spark, sf).withColumn("low", wilson_low(F.col("k"), F.col("n")))
    rows = rows.withColumn("state", trust_state(F.col("n"), F.col("low"), F.col("forecaster") % 97 == 0))
    return rows.select("forecaster", "state", F.round(authority_score(F.col("n"), F.col("low"), F.col("mean_return")), 4).alias("score"), F.round(authority_weight(F.col("n"), F.col("low"), F.col("state")), 6).alias("weight"))


_AUTHORITY = ("calls", "n", "k", "state")
_AUTHORITY_ROUNDED = ("mean_return", "median_return", "mean_relative", "recency_accuracy", "calibration", "accuracy", "wilson_low", "wilson_high", "bayes_mean", "score")
_Z2 = "1.96 * 1.96"


def _wilson_sql(sign: str, none: int) -> str:
    return f"CASE WHEN n > 0 THEN greatest(least((k / n + {_Z2} / (2.0 * n) {sign} 1.96 * sqrt(k / n * (1 - k / n) / n + {_Z2} / (4.0 * n * n))) / (1 + {_Z2} / n), 1), 0) ELSE {none} END"


@query(f"""WITH c AS (SELECT o_custkey AS forecaster, o_orderdate AS ts, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) END AS game, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'ja' END AS language, (o_orderkey % 3)::VARCHAR AS set_key, CASE WHEN o_totalprice < 25000 THEN 'lt_25' WHEN o_totalprice < 100000 THEN '25_100' WHEN o_totalprice < 500000 THEN '100_500' ELSE 'gte_500' END AS tier, CASE WHEN o_orderkey % 4 < 2 THEN '7d' ELSE '30d' END AS horizon,
 o_orderstatus = 'F' AS hit, o_orderstatus IN ('F', 'O') AS directional, (o_totalprice - 250000) / 500000 AS ret, CASE WHEN o_orderkey % 3 = 0 THEN (o_totalprice - 250000) / 500000 - 0.05 END AS relative, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS confidence FROM orders),
x AS (SELECT * FROM c UNION ALL SELECT * REPLACE ('*' AS set_key, '*' AS tier, '*' AS horizon) FROM c UNION ALL SELECT * REPLACE ('*' AS game, '*' AS language, '*' AS set_key, '*' AS tier, '*' AS horizon) FROM c),
y AS (SELECT *, pow(0.5::DOUBLE, epoch(TIMESTAMP '{LONG_ASOF}' - ts) / 86400.0 / 180.0) AS w FROM x),
a AS (SELECT forecaster, game, language, set_key, tier, horizon, count(*) AS calls, count(*) FILTER (WHERE directional) AS n, count(*) FILTER (WHERE hit) AS k, avg(ret) AS mean_return, median(ret) AS median_return, avg(relative) AS mean_relative, sum(w * hit::INT) FILTER (WHERE directional) / sum(w) FILTER (WHERE directional) AS recency_accuracy, avg((confidence - hit::INT) ** 2) FILTER (WHERE directional AND confidence IS NOT NULL) AS calibration FROM y GROUP BY ALL),
t AS (SELECT user_id AS forecaster, arg_max((props->>'$.k')::BIGINT % 10 = 0, (ts, event_id)) AS excluded FROM events WHERE event_type = 'error' GROUP BY 1),
l AS (SELECT a.*, {_wilson_sql('-', 0)} AS low, {_wilson_sql('+', 1)} AS high, coalesce(excluded, false) AS excluded FROM a LEFT JOIN t ON t.forecaster = a.forecaster),
s AS (SELECT *, CASE WHEN excluded THEN 'excluded' WHEN n < 5 THEN 'low_confidence' WHEN low < 0.35 AND n >= 8 THEN 'unreliable' WHEN n < 20 THEN 'developing' WHEN n >= 50 AND low >= 0.62 THEN 'trusted' WHEN low >= 0.5 THEN 'reliable' ELSE 'developing' END AS state,
 CASE WHEN n > 0 THEN k / n END AS accuracy, CASE WHEN n > 0 THEN low END AS wilson_low, CASE WHEN n > 0 THEN high END AS wilson_high, CASE WHEN n > 0 THEN (k + 8) / (n + 16) END AS bayes_mean, least(greatest(100 * (0.85 * low + 0.15 * (0.5 + coalesce(least(greatest(mean_return, -0.5), 0.5), 0))) * n / (n + 20), 0), 100) AS score FROM l),
w AS (SELECT *, CASE state WHEN 'excluded' THEN 0 WHEN 'unreliable' THEN 0.05 * n / (n + 20) ELSE n / (n + 20) * CASE state WHEN 'trusted' THEN 1 WHEN 'reliable' THEN 0.8 WHEN 'developing' THEN 0.45 ELSE 0.2 END * low END AS weight FROM s)
SELECT forecaster, game, language, set_key, tier, horizon, {', '.join(_AUTHORITY)}, {', '.join(f'round({c} + 1e-9, 5) + 0.0 AS {c}' for c in _AUTHORITY_ROUNDED)}, round(weight, 6) AS weight FROM w""")
def authority_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as calls of customers; error events of the same number as trust events."""
    i, price, c = F.col("o_orderkey"), F.col("o_totalprice"), F.col
    ret = (price - 250000) / 500000
    calls = table(spark, sf, "orders").select(
        c("o_custkey").alias("forecaster"), micros(c("o_orderdate")).alias("at"), F.when(i % 11 != 0, F.substring("o_orderpriority", 1, 1)).alias("game"), F.when(i % 2 == 0, "en").otherwise("ja").alias("language"), (i % 3).alias("set_key"), price_tier(price / 1000).alias("tier"), F.when(i % 4 < 2, "7d").otherwise("30d").alias("horizon"),
        F.when(c("o_orderstatus") == "F", "correct").when(c("o_orderstatus") == "O", "incorrect").otherwise("flat").alias("verdict"), ret.alias("ret"), F.when(i % 3 == 0, ret - 0.05).alias("relative"), F.when(i % 5 == 0, (i % 100) / 100).alias("confidence"),
    )
    stated = events(spark, sf, "error").select(c("instrument").alias("forecaster"), "at", "id", F.when(c("k") % 10 == 0, "excluded").otherwise("restored").alias("state"))
    found = authority.slices(calls, authority.latest_trust(stated, "forecaster"), "forecaster", instant(LONG_ASOF))
    return found.select("forecaster", *authority.SLICE, *_AUTHORITY, *[(F.round(F.col(x) + 1e-9, 5) + 0.0).alias(x) for x in _AUTHORITY_ROUNDED], F.round("weight", 6).alias("weight"))


# scores ----------------------------------------------------------------------------------------------


def _combine_sql(weights: dict[str, float], scores: dict[str, str]) -> str:
    used = {k: s for k, s in scores.items() if s != "NULL"}
    top = " + ".join(f"coalesce({weights[k]} * ({s}), 0)" for k, s in used.items())
    bottom = " + ".join(f"CASE WHEN ({s}) IS NOT NULL THEN {weights[k]} ELSE 0 END" for k, s in used.items())
    return f"CASE WHEN ({bottom}) = 0 THEN 50 ELSE least(greatest(({top})::DOUBLE / nullif(({bottom})::DOUBLE, 0), 0), 100) END"


def _clamp(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, 0), 100) END)"


_VOTES = f"""votes AS (SELECT user_id AS instrument, CASE (props->>'$.k')::BIGINT % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'watch' END AS direction, ((props->>'$.k')::BIGINT % 7) / 50.0::DOUBLE AS w FROM events WHERE event_type = 'signup' AND {_in(30)}),
vmean AS (SELECT instrument, sum(w) AS total_weight, sum(w * CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END) / nullif(sum(w), 0) AS mean FROM votes GROUP BY 1),
vc AS (SELECT vmean.instrument, total_weight, CASE WHEN total_weight >= 0.05 THEN any_value(mean) END AS consensus, CASE WHEN total_weight >= 0.05 THEN sum(w * abs(CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END - mean)) / nullif(total_weight, 0) END AS disagreement FROM vmean JOIN votes USING (instrument) GROUP BY vmean.instrument, total_weight)"""
_SOCIAL = f"""so AS (SELECT user_id AS instrument, count(*) FILTER (WHERE {_in(7)}) AS m7, count(*) FILTER (WHERE {_in(7, 7)}) AS p7, count(DISTINCT (props->>'$.k')::BIGINT) FILTER (WHERE {_in(7)}) AS contents, count(DISTINCT (props->>'$.k')::BIGINT % 10) FILTER (WHERE {_in(7)}) AS accounts, coalesce(sum(value) FILTER (WHERE {_in(7)}), 0) * 40 AS engagement FROM events WHERE event_type = 'click' GROUP BY 1),
sc AS (SELECT *, CASE WHEN m7 > 0 OR contents > 0 THEN {_clamp("40 + 30 * least(greatest(CASE WHEN p7 >= 2 THEN m7 / p7 - 1 WHEN m7 >= 3 THEN 1 ELSE 0 END, -1), 2) + 20 * least(1, accounts / 8 + contents / 8) + 10 * least(1, engagement / 50000)")} END AS social FROM so)"""


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.times import trailing

    rows = events(spark, sf, "signup").where(trailing(F.col("at"), instant(ASOF), 30))
    direction = F.when(F.col("k") % 3 == 0, "bullish").when(F.col("k") % 3 == 1, "bearish").otherwise("watch")
    return rows.groupBy("instrument").agg(*[c.alias(n) for n, c in scoring.consensus(direction, (F.col("k") % 7) / 50.0).items()])


def _social(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.times import trailing

    now = trailing(F.col("at"), instant(ASOF), 7)
    found = events(spark, sf, "click").groupBy("instrument").agg(F.count_if(now).alias("m7"), F.count_if(trailing(F.col("at"), instant(ASOF), 7, 7)).alias("p7"), F.countDistinct(F.when(now, F.col("k"))).alias("contents"), F.countDistinct(F.when(now, F.col("k") % 10)).alias("accounts"), (F.coalesce(F.sum(F.when(now, F.col("price"))), F.lit(0.0)) * 40).alias("engagement"))
    return found.withColumn("social", scoring.social_score(*[F.col(c) for c in ("m7", "p7", "contents", "accounts", "engagement")]))


_MISSING = {"price_momentum": "CASE WHEN o_orderkey % 2 = 0 THEN 70 END", "volume_momentum": "CASE WHEN o_orderkey % 3 = 0 THEN 20 END", "sales_velocity": "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 101 END", "relative_strength": "NULL", "supply_absorption": "CASE WHEN o_orderkey % 7 = 0 THEN 55 END", "creator_consensus": "NULL", "social_momentum": "NULL"}


@query(f"SELECT o_orderkey AS id, round({_combine_sql(scoring.OPPORTUNITY_WEIGHTS, _MISSING)}, 6) AS score FROM orders")
def score_combine_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of missing parts go to the others; with all missing the score is 50."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    i = F.col("id")
    part = scoring.parts(scoring.OPPORTUNITY_WEIGHTS, {"price_momentum": F.when(i % 2 == 0, 70), "volume_momentum": F.when(i % 3 == 0, 20), "sales_velocity": F.when(i % 5 == 0, i % 101), "relative_strength": F.lit(None), "supply_absorption": F.when(i % 7 == 0, 55), "creator_consensus": F.lit(None), "social_momentum": F.lit(None)})
    return rows.select("id", F.round(scoring.combine(part), 6).alias("score"))


@query(f"WITH {_VOTES} SELECT instrument, round(total_weight, 6) AS total_weight, round(consensus, 6) + 0.0 AS consensus, round(disagreement, 6) AS disagreement FROM vc")
def score_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return _votes(spark, sf).select("instrument", *[(F.round(c, 6) + 0.0).alias(c) for c in ("total_weight", "consensus", "disagreement")])


@query(f"WITH {_SOCIAL} SELECT instrument, m7, p7, contents, accounts, round(social, 6) AS social FROM sc")
def score_social_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return _social(spark, sf).select("instrument", "m7", "p7", "contents", "accounts", F.round("social", 6).alias("social"))


_CONF, _HYPE = "coalesce(n7 >= 3, false)", "(coalesce(social >= 65, false) AND NOT coalesce(n7 >= 3, false))"
_SCORED = f"""{VECTOR}, {_VOTES}, {_SOCIAL}, bench AS (SELECT avg(ret_7d) AS b FROM v), sp AS (SELECT instrument, arg_max(low_price, (ts, id)) AS ask FROM q WHERE ts <= {A} GROUP BY 1), sold AS (SELECT instrument, arg_max(price, (ts, id)) AS sold FROM t WHERE ts <= {A} GROUP BY 1),
i AS (SELECT v.*, momentum - b AS relative_strength, CASE WHEN sold > 0 THEN ask / sold END AS spread_ratio, consensus, disagreement, total_weight, social, (v.n > 0)::INT + (v.listing_count IS NOT NULL)::INT + (social IS NOT NULL)::INT AS sources FROM v CROSS JOIN bench LEFT JOIN sp USING (instrument) LEFT JOIN sold USING (instrument) LEFT JOIN vc USING (instrument) LEFT JOIN sc USING (instrument)),
p AS (SELECT instrument, n, n7, quality, social,
 {_combine_sql(scoring.OPPORTUNITY_WEIGHTS, {"price_momentum": _clamp("50 + momentum / 0.2 * 50"), "volume_momentum": _clamp("50 + volume_momentum * 50"), "sales_velocity": _clamp("per_day * 100"), "relative_strength": _clamp("50 + relative_strength / 0.15 * 50"), "supply_absorption": _clamp("absorption * 100"), "creator_consensus": _clamp("50 + consensus * 50"), "social_momentum": "social"})} AS opp0,
 {_combine_sql(scoring.RISK_WEIGHTS, {"volatility": _clamp("volatility / 0.15 * 100"), "thin_liquidity": _clamp("100 - n7 / 10 * 100"), "spread": _clamp("(spread_ratio - 1) * 200"), "low_sample": _clamp("100 - n / 20 * 100"), "outlier_dependence": "CASE WHEN outlier_driven OR quality = 'outlier_dependent' THEN 80 ELSE 15 END", "social_unconfirmed": f"CASE WHEN {_HYPE} THEN 85 WHEN thin_volume_spike THEN 70 END", "supply_shock": "CASE WHEN supply_disappearance OR coalesce(listing_change < 0 AND n7 = 0, false) THEN 75 END", "creator_disagreement": _clamp("disagreement * 100")})} AS risk,
 {_combine_sql(scoring.CONFIDENCE_WEIGHTS, {"market_sample": _clamp("n / 12 * 100"), "source_coverage": _clamp("sources * 40.0"), "freshness": _clamp("100 - staleness_hours / 504 * 100"), "resolution_certainty": "100", "creator_reliability": "CASE WHEN consensus IS NOT NULL THEN " + _clamp("total_weight * 200") + " END", "cross_source": "CASE WHEN sources >= 2 THEN 80 ELSE 35 END"})} AS confidence,
 {_combine_sql(scoring.LIQUIDITY_WEIGHTS, {"sales_frequency": _clamp("n7 / 8 * 100"), "intersale_time": _clamp("100 - median_intersale_ms / 86400000 / 14 * 100"), "listing_depth": _clamp("listing_count / 20 * 100"), "spread": _clamp("100 - greatest(0, spread_ratio - 1) / 0.35 * 100").replace("greatest(0, spread_ratio - 1)", "(CASE WHEN spread_ratio IS NOT NULL THEN greatest(0, spread_ratio - 1) END)"), "seller_diversity": "NULL", "historical_sales": _clamp("n30 / 20 * 100")})} AS liquidity FROM i),
z AS (SELECT *, CASE WHEN {_HYPE} THEN least(opp0, 55) ELSE opp0 END AS opportunity, {_CONF} AND NOT {_HYPE} AS sound FROM p),
scored AS (SELECT instrument, opportunity, risk, confidence, liquidity, CASE WHEN n < 3 OR quality = 'insufficient_data' OR confidence < 25 THEN 'insufficient_data' WHEN NOT sound AND opportunity >= 50 AND risk <= 65 THEN 'watch' WHEN sound AND opportunity >= 75 AND risk <= 40 AND confidence >= 60 AND liquidity >= 55 THEN 'strong_buy' WHEN sound AND opportunity >= 60 AND risk <= 50 AND confidence >= 50 AND liquidity >= 45 THEN 'buy'
 WHEN opportunity >= 50 AND risk <= 65 THEN 'watch' WHEN opportunity <= 30 AND risk >= 80 THEN 'strong_sell' WHEN opportunity <= 35 AND risk >= 65 THEN 'sell' WHEN opportunity <= 40 AND risk >= 55 THEN 'reduce' WHEN opportunity >= 40 THEN 'hold' ELSE 'watch' END AS recommendation FROM z)"""


def score_inputs(spark: SparkSession, sf: str) -> DataFrame:
    asof = instant(ASOF)
    vector = materialised(event_features(spark, sf))  # one row an instrument, for the benchmark and the scores
    bench = vector.agg(F.avg("ret_7d").alias("_bench"))
    newest = lambda df, c, n: df.where(F.col("at") <= asof).groupBy("instrument").agg(F.max_by(c, F.struct("at", "id")).alias(n))
    rows = vector.join(F.broadcast(bench), how="cross")  # one row
    rows = rows.join(newest(quotes(spark, sf), "low_price", "_ask"), "instrument", "left").join(newest(trades(spark, sf), "price", "_sold"), "instrument", "left")
    rows = rows.join(_votes(spark, sf), "instrument", "left").join(_social(spark, sf).select("instrument", "social"), "instrument", "left")
    sources = (F.col("n") > 0).cast("int") + F.col("listing_count").isNotNull().cast("int") + F.col("social").isNotNull().cast("int")
    return rows.withColumns({"relative_strength": F.col("momentum") - F.col("_bench"), "spread_ratio": F.when(F.col("_sold") > 0, F.col("_ask") / F.col("_sold")), "sources": sources})


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return score_inputs(spark, sf).select("instrument", *[c.alias(k) for k, c in scoring.score_columns().items()])


SCORES = ("opportunity", "risk", "confidence", "liquidity")


@query(f"WITH {_SCORED} SELECT instrument, {', '.join(f'round({c}, 4) AS {c}' for c in SCORES)}, recommendation FROM scored")
def score_opportunity_full(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("instrument", *[F.round(c, 4).alias(c) for c in SCORES], "recommendation")


@query(f"WITH {_SCORED} SELECT instrument, round(opportunity, 4) AS opportunity, recommendation FROM scored WHERE risk <= 75 ORDER BY opportunity DESC, instrument LIMIT 50")
def latest_opportunities_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best opportunities under a bound on risk: a top-k report."""
    return scores(spark, sf).where("risk <= 75").orderBy(F.desc("opportunity"), "instrument").limit(50).select("instrument", F.round("opportunity", 4).alias("opportunity"), "recommendation")


# forecasts -------------------------------------------------------------------------------------------

_ISSUED = "2024-01-20 00:00:00"


def _forecast_sql(cte: str, days: str) -> str:
    base = "coalesce(ret_30d, ret_7d)"
    return f"""{cte}, fx AS (SELECT instrument, last_price, n, {base} * ({days} / CASE WHEN ret_30d IS NOT NULL THEN 30.0 ELSE 7.0 END)::DOUBLE AS expected, coalesce(volatility, 0.12) * 1.5 * sqrt({days} / 30.0) AS width, coalesce(volatility, 0.12) AS vol, quality AS q0 FROM v),
fc AS (SELECT instrument, last_price, expected, expected - width AS low, expected + width AS high, CASE WHEN expected IS NULL THEN 0.5 ELSE least(greatest(1 / (1 + exp(-expected / 0.08)), 0.05), 0.95) END AS p_up, least(greatest(20 + least(n, 20) * 3 + CASE WHEN q0 = 'complete' THEN 15 ELSE 0 END, 5), 90)::DOUBLE AS confidence, least(greatest(vol * 400, 10), 95) AS risk, CASE WHEN last_price IS NULL OR expected IS NULL OR n < 2 THEN 'insufficient_data' ELSE q0 END AS quality FROM fx)"""


def _features_at(spark: SparkSession, sf: str, asof: str) -> DataFrame:
    from ..operators.features import feature_vector

    return feature_vector(series.outlier_flags(trades(spark, sf)), quotes(spark, sf), instant(asof))


def _model(rows: DataFrame, days: int) -> DataFrame:
    c = F.col
    made = forecast.stats_baseline(F.lit(float(days)), c("ret_30d"), c("ret_7d"), c("volatility"), c("n"), c("quality"), c("last_price"))
    return rows.select("instrument", "last_price", *[x.alias(k) for k, x in made.items()])


@query(f"WITH {_forecast_sql(VECTOR, '7')} SELECT instrument, {', '.join(f'round({x}, 5) AS {x}' for x in ('expected', 'low', 'high', 'p_up', 'confidence', 'risk'))}, quality FROM fc")
def forecast_stats_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return _model(_features_at(spark, sf, ASOF), 7).select("instrument", *[F.round(x, 5).alias(x) for x in ("expected", "low", "high", "p_up", "confidence", "risk")], "quality")


@query(f"WITH {_forecast_sql(VECTOR, '30')} SELECT instrument, 'stats' AS model, round(expected, 5) AS expected, round(p_up, 5) AS p_up FROM fc UNION ALL SELECT instrument, 'no_change', 0.0, 0.5 FROM fc UNION ALL SELECT instrument, 'momentum', round(ret_7d * (30 / 7.0)::DOUBLE, 5), round(CASE WHEN ret_7d IS NULL THEN 0.5 ELSE least(greatest(1 / (1 + exp(-ret_7d * (30 / 7.0)::DOUBLE / 0.08)), 0.05), 0.95) END, 5) FROM v")
def forecast_baselines_compare(spark: SparkSession, sf: str) -> DataFrame:
    rows, c, days = _features_at(spark, sf, ASOF), F.col, F.lit(30.0)
    made = {"stats": forecast.stats_baseline(days, c("ret_30d"), c("ret_7d"), c("volatility"), c("n"), c("quality"), c("last_price")), "no_change": forecast.no_change(c("quality"), c("last_price")), "momentum": forecast.momentum(days, c("ret_7d"), c("volatility"), c("n"), c("quality"), c("last_price"))}
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.round(x["expected"], 5).alias("expected"), F.round(x["p_up"], 5).alias("p_up")) for m, x in made.items()])
    return rows.select("instrument", F.explode(each).alias("m")).select("instrument", "m.*")


def _vector_at(asof: str) -> str:
    from .features import FLAGGED, _vector_sql

    return _vector_sql(FLAGGED.replace(f"ts <= {A}", f"ts <= TIMESTAMP '{asof}'"), QUOTES, asof)


def _evaluate(forecasts: DataFrame, flagged: DataFrame, days: int) -> DataFrame:
    """Forecasts (instrument, at, last_price, ...) against the unflagged trades of the days after their issue."""
    clean = flagged.where("not outlier")
    keyed = forecasts.withColumn("id", F.xxhash64("instrument", "at"))
    held = keyed.select(F.struct(*keyed.columns).alias("_f"), "instrument", F.col("at").alias("_at"))  # forecasts have a low and a high of their own
    met = windows.window_extremes(held, clean, "instrument", F.col("_at"), F.col("_at") + days * DAY)
    found, c = met.select("_f.*", F.col("last").alias("_last"), F.col("high").alias("_peak"), F.col("low").alias("_trough")), F.col
    return found.withColumns(forecast.evaluation(c("last_price"), c("_last"), c("_peak"), c("_trough"), c("expected"), c("low"), c("high"), c("p_up")))


def _evaluated_sql(name: str, asof: str) -> str:
    return f"""e_{name} AS (SELECT fc.instrument, fc.last_price, expected, low, high, p_up, arg_max(y.price, (y.ts, y.id)) / fc.last_price - 1 AS actual, max(y.price) / fc.last_price - 1 AS top, min(y.price) / fc.last_price - 1 AS bottom FROM fc LEFT JOIN (SELECT * FROM (SELECT id, ts, instrument, price, coalesce(m > 0 AND (price > m * 5 OR price < m * 0.2::DOUBLE), false) AS outlier FROM fm) WHERE NOT outlier) y ON y.instrument = fc.instrument AND y.ts > TIMESTAMP '{asof}' AND y.ts <= TIMESTAMP '{asof}' + INTERVAL 7 DAY GROUP BY fc.instrument, fc.last_price, expected, low, high, p_up)"""


@query(f"WITH {_forecast_sql(_vector_at(_ISSUED), '7')}, {_evaluated_sql('a', _ISSUED)} SELECT instrument, round(actual, 5) AS actual, round(actual - expected, 5) AS error, (p_up >= 0.5) = (actual > 0) AS direction_correct, actual BETWEEN low AND high AS range_hit, round((p_up - (actual > 0)::INT) ** 2, 5) AS brier, round(CASE WHEN top > 0 THEN (top - actual) / (1 + top) WHEN bottom IS NOT NULL THEN abs(least(bottom, 0)) ELSE 0 END, 5) AS drawdown FROM e_a")
def forecast_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    issued = _model(_features_at(spark, sf, _ISSUED), 7).withColumn("at", instant(_ISSUED))
    return _evaluate(issued, series.outlier_flags(trades(spark, sf)), 7).select("instrument", *[F.round(x, 5).alias(x) for x in ("actual", "error")], "direction_correct", "range_hit", F.round("brier", 5).alias("brier"), F.round("drawdown", 5).alias("drawdown"))


WALK = ("2024-01-12 00:00:00", "2024-01-16 00:00:00", "2024-01-20 00:00:00")


def _walk_sql() -> str:
    parts = []
    for d in WALK:
        parts.append(f"SELECT '{d[:10]}' AS issued, count(actual) AS n, round(avg(abs(actual - expected)), 5) AS mae, round(avg(CASE WHEN actual IS NOT NULL THEN ((p_up >= 0.5) = (actual > 0))::INT END), 5) AS direction, round(avg((actual BETWEEN low AND high)::INT), 5) AS coverage, round(avg((p_up - (actual > 0)::INT) ** 2), 5) AS brier FROM (WITH {_forecast_sql(_vector_at(d), '7')}, {_evaluated_sql('w', d)} SELECT * FROM e_w)")
    return " UNION ALL ".join(parts)


@query(_walk_sql())
def forecast_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Issue at each date, evaluate a week later, and report by date."""
    flagged, issued = materialised(series.outlier_flags(trades(spark, sf))), None
    for d in WALK:
        rows = _model(features.feature_vector(flagged, quotes(spark, sf), instant(d)), 7).withColumns({"at": instant(d), "issued": F.lit(d[:10])})
        issued = rows if issued is None else issued.unionByName(rows)
    c = F.col
    return _evaluate(issued, flagged, 7).groupBy("issued").agg(F.count("actual").alias("n"), F.round(F.avg(F.abs("error")), 5).alias("mae"), F.round(F.avg(c("direction_correct").cast("int")), 5).alias("direction"), F.round(F.avg(c("range_hit").cast("int")), 5).alias("coverage"), F.round(F.avg("brier"), 5).alias("brier"))


_CALIBRATED_UNTIL = WALK[0]


def _backtest_sql() -> str:
    """Every model's forecasts of the dates after calibration, with what came of them."""
    logistic = "CASE WHEN {0} IS NULL THEN 0.5 ELSE least(greatest(1 / (1 + exp(-({0}) / 0.08)), 0.05), 0.95) END"
    parts = []
    for d in WALK:
        if d > _CALIBRATED_UNTIL:
            parts.append(f"""SELECT '{d[:10]}' AS issued, model, m.expected, m.low, m.high, m.p_up, actual FROM (WITH {_forecast_sql(_vector_at(d), '7')}, {_evaluated_sql('w', d)},
mm AS (SELECT instrument, 'stats' AS model, expected, low, high, p_up FROM fc UNION ALL SELECT instrument, 'no_change', 0.0, -0.05, 0.05, 0.5 FROM fc UNION ALL SELECT instrument, 'momentum', x, x - w, x + w, {logistic.format('x')} FROM (SELECT instrument, ret_7d AS x, coalesce(volatility, 0.12) * 1.5 * sqrt(7 / 30.0) AS w FROM v))
SELECT mm.*, e_w.actual FROM mm JOIN e_w USING (instrument)) m""")
    return f"b AS ({' UNION ALL '.join(parts)}), z AS (SELECT * FROM b WHERE actual IS NOT NULL AND expected IS NOT NULL)"


def _backtest(spark: SparkSession, sf: str) -> DataFrame:
    flagged, c, days = materialised(series.outlier_flags(trades(spark, sf))), F.col, F.lit(7.0)
    issued = None
    for d in forecast.after_calibration(WALK, _CALIBRATED_UNTIL):
        rows = features.feature_vector(flagged, quotes(spark, sf), instant(d))
        made = {"stats": forecast.stats_baseline(days, c("ret_30d"), c("ret_7d"), c("volatility"), c("n"), c("quality"), c("last_price")), "no_change": forecast.no_change(c("quality"), c("last_price")), "momentum": forecast.momentum(days, c("ret_7d"), c("volatility"), c("n"), c("quality"), c("last_price"))}
        models = F.array(*[F.struct(F.lit(m).alias("model"), *[x[k].cast("double").alias(k) for k in ("expected", "low", "high", "p_up")]) for m, x in made.items()])
        part = rows.select("instrument", "last_price", instant(d).alias("at"), F.lit(d[:10]).alias("issued"), models.alias("models"))
        issued = part if issued is None else issued.unionByName(part)
    # a window is looked up once for all models
    opened = issued.withColumns({k: F.lit(None).cast("double") for k in ("expected", "low", "high", "p_up")})
    met = _evaluate(opened, flagged, 7).select("instrument", "issued", "actual", F.explode("models").alias("m")).select("instrument", "issued", "actual", "m.*")
    return met.where("actual is not null and expected is not null")


@query(f"WITH {_backtest_sql()} SELECT model, count(*) AS n, round(avg(((p_up >= 0.5) = (actual > 0))::INT), 5) AS direction_accuracy, round(avg(abs(actual - expected)), 5) AS mae, round(sqrt(avg((actual - expected) ** 2)), 5) AS rmse, round(avg((actual BETWEEN low AND high)::INT), 5) AS range_coverage, round(avg((p_up - (actual > 0)::INT) ** 2), 5) AS mean_brier FROM z GROUP BY model")
def forecast_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """The model and its baselines over the dates after the calibration's end."""
    return forecast.backtest_metrics(_backtest(spark, sf), "model").select("model", "n", *[F.round(x, 5).alias(x) for x in ("direction_accuracy", "mae", "rmse", "range_coverage", "mean_brier")])


@query(f"WITH {_backtest_sql()}, k AS (SELECT *, least(floor(p_up * 5), 4)::INT AS bucket FROM z) SELECT m.model, r.bucket::INT AS bucket, count(k.p_up) AS n, round(avg(k.p_up), 5) AS mean_p, round(avg((k.actual > 0)::INT), 5) AS mean_y FROM (SELECT DISTINCT model FROM z) m CROSS JOIN range(5) r(bucket) LEFT JOIN k ON k.model = m.model AND k.bucket = r.bucket GROUP BY ALL")
def forecast_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """How often prices rose where a model gave a probability, in five buckets; empty ones are shown."""
    return forecast.calibration(_backtest(spark, sf), "model").select("model", "bucket", "n", F.round("mean_p", 5).alias("mean_p"), F.round("mean_y", 5).alias("mean_y"))
