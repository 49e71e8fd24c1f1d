"""Aggregate and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import half_life
from ..functions.times import DAY, instant, trailing
from ..operators import features, selection, series
from ..sources.tables import claims, daily_trades, events, quotes, table, trades
from .catalog import ASOF, DAILY, LONG_ASOF, QUOTES, TRADES, query

A = f"TIMESTAMP '{ASOF}'"


def _in(days: int, lag: int = 0, asof: str = ASOF) -> str:
    return f"ts > TIMESTAMP '{asof}' - INTERVAL {days + lag} DAY AND ts <= TIMESTAMP '{asof}' - INTERVAL {lag} DAY"


@query(f"WITH {TRADES} SELECT instrument, count(*) FILTER (WHERE {_in(1)}) AS n1, count(*) FILTER (WHERE {_in(7)}) AS n7, count(*) FILTER (WHERE {_in(30)}) AS n30, round(count(*) FILTER (WHERE {_in(30)}) / 30.0, 6) AS per_day FROM t GROUP BY instrument")
def agg_sales_velocity(spark: SparkSession, sf: str) -> DataFrame:
    v = features.velocity(F.col("at"), instant(ASOF))
    return trades(spark, sf).groupBy("instrument").agg(v["n1"].alias("n1"), v["n7"].alias("n7"), v["n30"].alias("n30"), F.round(v["per_day"], 6).alias("per_day"))


@query(f"WITH {TRADES}, c AS (SELECT instrument, count(*) FILTER (WHERE {_in(7)}) AS n7, count(*) FILTER (WHERE {_in(7, 7)}) AS prior7 FROM t GROUP BY instrument) SELECT instrument, n7, prior7, round(CASE WHEN n7 >= 2 AND prior7 >= 2 THEN n7 / prior7 - 1 END, 6) AS volume_momentum FROM c")
def agg_volume_momentum(spark: SparkSession, sf: str) -> DataFrame:
    v = features.velocity(F.col("at"), instant(ASOF))
    found = trades(spark, sf).groupBy("instrument").agg(v["n7"].alias("n7"), v["prior7"].alias("prior7"))
    return found.withColumn("volume_momentum", F.round(features.momentum_of_volume(), 6))


SUPPLY = f"qq AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, id DESC) AS r FROM q WHERE ts <= {A}), sup AS (SELECT instrument, max(listing_count) FILTER (WHERE r = 1) AS listing_count, max(listing_count) FILTER (WHERE r = 2) AS listing_prev, max(low_price) FILTER (WHERE r = 1) AS low_now, max(low_price) FILTER (WHERE r = 2) AS low_prev FROM qq WHERE r <= 2 GROUP BY instrument)"


@query(f"""WITH {TRADES}, {QUOTES}, {SUPPLY}, c AS (SELECT instrument, count(*) FILTER (WHERE {_in(7)}) AS n7 FROM t GROUP BY instrument)
SELECT instrument, listing_count, listing_count - listing_prev AS listing_change, round(CASE WHEN n7 > 0 THEN listing_count / n7 END, 6) AS listing_sale_ratio, round(CASE WHEN listing_count > 0 THEN n7 / listing_count END, 6) AS absorption FROM sup JOIN c USING (instrument)""")
def agg_supply_ratios(spark: SparkSession, sf: str) -> DataFrame:
    n7 = trades(spark, sf).groupBy("instrument").agg(F.count_if(trailing(F.col("at"), instant(ASOF), 7)).alias("n7"))
    found = features.supply(quotes(spark, sf), instant(ASOF)).join(n7, "instrument")
    return found.select("instrument", "listing_count", (F.col("listing_count") - F.col("listing_prev")).alias("listing_change"), F.round(F.when(F.col("n7") > 0, F.col("listing_count") / F.col("n7")), 6).alias("listing_sale_ratio"), F.round(F.when(F.col("listing_count") > 0, F.col("n7") / F.col("listing_count")), 6).alias("absorption"))


@query("SELECT instrument, sum(n)::BIGINT AS n, string_agg(source || ':' || n, ',' ORDER BY source) AS composition FROM (SELECT l_partkey AS instrument, l_suppkey AS source, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def agg_source_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Each instrument's map of counts by source, shown in order of source."""
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("instrument"), F.col("l_suppkey").alias("source")).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.map_entries("source_composition"))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return features.source_composition(counts).select("instrument", F.aggregate(F.map_values("source_composition"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n"), shown.alias("composition"))


@query("""WITH l AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS price FROM lineitem), m AS (SELECT flag, status, median(price) AS median FROM l GROUP BY ALL)
SELECT flag, status, median, median(abs(price - median)) AS mad FROM l JOIN m USING (flag, status) GROUP BY ALL""")
def agg_exact_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Exact medians and median deviations of a few groups that hold all line items between them."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price"))
    return selection.group_mads(rows, ["flag", "status"], "price")


CLICKS = "c AS (SELECT event_id AS id, ts, user_id AS instrument, value, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'click')"


@query(f"WITH {CLICKS} SELECT instrument, count(*) AS mentions, count(DISTINCT k) AS contents, count(DISTINCT CASE WHEN k % 6 <> 0 THEN k % 10 END) AS accounts, round(count(*) / 7.0, 6) AS per_day FROM c WHERE {_in(7)} GROUP BY instrument")
def agg_mention_velocity(spark: SparkSession, sf: str) -> DataFrame:
    seen = events(spark, sf, "click").where(trailing(F.col("at"), instant(ASOF), 7))
    return seen.groupBy("instrument").agg(F.count("*").alias("mentions"), F.countDistinct("k").alias("contents"), F.countDistinct(F.when(F.col("k") % 6 != 0, F.col("k") % 10)).alias("accounts"), F.round(F.count("*") / 7.0, 6).alias("per_day"))


@query(f"""WITH {CLICKS}, r AS (SELECT * FROM c WHERE {_in(7)}), e AS (SELECT (props->>'$.k')::BIGINT AS k, value FROM events WHERE event_type = 'view' AND {_in(7)})
SELECT i.instrument, coalesce(m7, 0) AS m7, coalesce(p7, 0) AS p7, coalesce(contents, 0) AS contents, round(coalesce(x.engagement, 0), 6) AS engagement
FROM (SELECT instrument, count(*) FILTER (WHERE {_in(7)}) AS m7, count(*) FILTER (WHERE {_in(7, 7)}) AS p7, count(DISTINCT k) FILTER (WHERE {_in(7)}) AS contents FROM c GROUP BY instrument) i
LEFT JOIN (SELECT d.instrument, sum(coalesce(e.value, 0)) AS engagement FROM (SELECT DISTINCT instrument, k FROM r) d JOIN e ON e.k = d.k GROUP BY d.instrument) x USING (instrument)""")
def agg_social_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in two windows, distinct contents, and the engagement with the contents mentioned lately."""
    asof, clicks = instant(ASOF), events(spark, sf, "click")
    recent = trailing(F.col("at"), asof, 7)
    counts = clicks.groupBy("instrument").agg(F.count_if(recent).alias("m7"), F.count_if(trailing(F.col("at"), asof, 7, 7)).alias("p7"), F.countDistinct(F.when(recent, F.col("k"))).alias("contents"))
    engagement = events(spark, sf, "view").where(recent).groupBy("k").agg(F.sum(F.coalesce("price", F.lit(0.0))).alias("e"))
    named = clicks.where(recent).select("instrument", "k").distinct().join(engagement, "k").groupBy("instrument").agg(F.sum("e").alias("engagement"))
    return counts.join(named, "instrument", "left").withColumn("engagement", F.round(F.coalesce("engagement", F.lit(0.0)), 6))


@query("SELECT c_mktsegment AS stage, count(*) AS n FROM customer GROUP BY 1")
def agg_group_count_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("stage")).agg(F.count("*").alias("n"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def agg_catalog_health_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH u AS (SELECT user_id AS organization, event_id, ts, (props->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id, (props->>'$.k')::BIGINT ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'signup')
SELECT organization, epoch_us(date_trunc('month', ts)) AS month_start, count(*) AS events, sum(k)::BIGINT AS quantity FROM u WHERE r = 1 GROUP BY ALL""")
def agg_month_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Month sums of usage whose idempotency key (here k) counts once for each organisation, at its first event."""
    rows = events(spark, sf, "signup")
    first = rows.groupBy(F.col("instrument").alias("organization"), "k").agg(F.min("at").alias("at"))
    month = F.unix_micros(F.date_trunc("month", F.timestamp_micros("at")))
    return first.groupBy("organization", month.alias("month_start")).agg(F.count("*").alias("events"), F.sum("k").alias("quantity"))


@query("""SELECT n_regionkey AS market, n_name AS language, c_mktsegment AS tier, grouping(n_regionkey)::INT * 4 + grouping(n_name)::INT * 2 + grouping(c_mktsegment)::INT AS level, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes, round(sum(o_totalprice), 2) AS total_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((), (n_regionkey, n_name), (n_regionkey, n_name, c_mktsegment))""")
def agg_grouping_sets_authority(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    cube = joined.groupingSets([[], ["n_regionkey", "n_name"], ["n_regionkey", "n_name", "c_mktsegment"]], "n_regionkey", "n_name", "c_mktsegment")
    return cube.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("successes"), F.round(F.sum("o_totalprice"), 2).alias("total_price")).withColumnsRenamed({"n_regionkey": "market", "n_name": "language", "c_mktsegment": "tier"})


@query("SELECT o_custkey AS forecaster, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY 1")
def agg_best_worst_call(spark: SparkSession, sf: str) -> DataFrame:
    return claims(spark, sf).groupBy("forecaster").agg(F.max_by("id", F.struct("price", -F.col("id"))).alias("best"), F.min_by("id", F.struct("price", "id")).alias("worst"))


PY = "p AS (SELECT o_orderkey AS id, o_custkey AS forecaster, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS actual, o_totalprice * (0.8 + (o_orderkey % 41) / 100.0::DOUBLE) AS predicted, o_orderdate AS ts FROM orders)"


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as probabilistic forecasts: p, the realised y, actual and predicted values."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key.alias("id"), F.col("o_custkey").alias("forecaster"), ((key * 7919 % 1000) / 1000.0).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("actual"), (F.col("o_totalprice") * (0.8 + (key % 41) / 100.0)).alias("predicted"), F.col("o_orderdate"))


def calibration_buckets(rows: DataFrame, size: int = 5) -> DataFrame:
    """n, mean p and mean y of each of size equal buckets of p; empty buckets are there with null means."""
    bucket = F.least(F.floor(F.col("p") * size), F.lit(size - 1)).cast("int")
    found = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    every = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    return every.join(F.broadcast(found), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))  # size rows


@query(f"WITH {PY}, b AS (SELECT least(floor(p * 5), 4)::INT AS bucket, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM p WHERE p < 0.75 GROUP BY 1) SELECT r.bucket, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y FROM (SELECT unnest(range(5))::INT AS bucket) r LEFT JOIN b USING (bucket)")
def agg_calibration_buckets(spark: SparkSession, sf: str) -> DataFrame:
    found = calibration_buckets(forecasts(spark, sf).where("p < 0.75"))
    return found.select("bucket", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


def error_metrics() -> dict[str, F.Column]:
    """Aggregates over actual, predicted, p and y. Relative errors leave out actual values under 1."""
    e = F.col("predicted") - F.col("actual")
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mape": F.avg(F.when(F.abs("actual") >= 1, F.abs(e / F.nullif(F.col("actual"), F.lit(0.0))))), "coverage": F.avg(F.col("actual").between(0.9 * F.col("predicted"), 1.1 * F.col("predicted")).cast("int")), "direction": F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")), "brier": F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))}


@query(f"WITH {PY} SELECT forecaster, count(*) AS n, round(avg(abs(predicted - actual)), 8) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 6) AS rmse, round(avg(CASE WHEN abs(actual) >= 1 THEN abs((predicted - actual) / actual) END), 6) AS mape, round(avg((actual BETWEEN 0.9 * predicted AND 1.1 * predicted)::INT), 6) AS coverage, round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS direction, round(avg((p - y) ** 2), 10) AS brier FROM p GROUP BY forecaster")
def agg_error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    digits = {"mae": 8, "brier": 10}
    return forecasts(spark, sf).groupBy("forecaster").agg(F.count("*").alias("n"), *[F.round(c, digits.get(k, 6)).alias(k) for k, c in error_metrics().items()])


@query(f"WITH {PY} SELECT forecaster, round(sum(pow(0.5, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(ts)) / 86400000000.0 / 180) * y) / sum(pow(0.5, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(ts)) / 86400000000.0 / 180)), 6) AS accuracy FROM p GROUP BY forecaster")
def agg_recency_weighted_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = claims(spark, sf).withColumn("y", (F.col("status") == "F").cast("int"))
    w = half_life((instant("2001-08-02 00:00:00") - F.col("at")) / float(DAY))
    return rows.groupBy("forecaster").agg(F.round(F.sum(w * F.col("y")) / F.sum(w), 6).alias("accuracy"))


@query(f"""WITH {QUOTES}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY instrument ORDER BY ts, id) AS gap, CASE WHEN listing_count > 20 THEN listing_count END AS bids FROM q)
SELECT instrument, count(*) AS n, arg_min(listing_count, (ts, id)) AS first_listing, arg_min(bids, (ts, id)) FILTER (WHERE bids IS NOT NULL) AS first_bids, median(gap) AS median_gap_us FROM g GROUP BY instrument""")
def agg_liquidity_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, the first known values in order of time, and the median time between quotes."""
    rows = quotes(spark, sf).withColumn("gap", F.col("at") - F.lag("at").over(series.sequence("instrument"))).withColumn("bids", F.when(F.col("listing_count") > 20, F.col("listing_count")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "id")))
    return rows.groupBy("instrument").agg(F.count("*").alias("n"), first("listing_count").alias("first_listing"), first("bids").alias("first_bids"), F.median("gap").alias("median_gap_us"))


# the feature vector ------------------------------------------------------------------------------------


def _vector_sql(trades_cte: str, quotes_cte: str, asof: str) -> str:
    """Common table expressions up to v, the feature vector, over x (id, ts, instrument, price, outlier) and q."""
    t = f"TIMESTAMP '{asof}'"
    picks = []
    for p in features.PERIODS:
        slack = max(1.0, 0.25 * p)
        for n, w in (("e", f"ts BETWEEN {t} - INTERVAL '{int(slack * 86400)} seconds' AND {t}"), ("s", f"ts BETWEEN {t} - INTERVAL '{int((p + slack) * 86400)} seconds' AND {t} - INTERVAL {p} DAY")):
            picks.append(f"arg_max(id, (ts, id)) FILTER (WHERE {w}) AS {n}i{p}, arg_max(price, (ts, id)) FILTER (WHERE {w}) AS {n}p{p}")
    rets = ", ".join(f"CASE WHEN ei{p} IS NOT NULL AND si{p} IS NOT NULL AND ei{p} <> si{p} AND sp{p} > 0 THEN ep{p} / sp{p} - 1 END AS ret_{p}d" for p in features.PERIODS)
    okp = " + ".join(f"(ret_{p}d IS NOT NULL)::INT" for p in features.PERIODS)
    month, d7, pd7 = _in(30, 0, asof), _in(7, 0, asof), _in(7, 7, asof)
    return f"""{trades_cte}, {quotes_cte},
s AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, id DESC) AS rk, count(*) FILTER (WHERE {month}) OVER (PARTITION BY instrument) AS nm FROM x WHERE NOT outlier),
a AS (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE {_in(1, 0, asof)}) AS n1, count(*) FILTER (WHERE {d7}) AS n7, count(*) FILTER (WHERE {month}) AS n30, count(*) FILTER (WHERE {pd7}) AS prior7,
  median(price) FILTER (WHERE {month}) AS rolling_median, avg(price) FILTER (WHERE {month}) AS sma0, list(price ORDER BY ts, id) FILTER (WHERE {month}) AS mp, max(price) AS peak, max(ts) AS last_ts,
  max(price) FILTER (WHERE rk = 1) AS last_price, max(price) FILTER (WHERE rk = 2) AS second_price, {', '.join(picks)} FROM s GROUP BY instrument),
vr AS (SELECT instrument, price / nullif(lag(price) OVER w, 0) - 1 AS r FROM s WHERE CASE WHEN nm >= 3 THEN {month} ELSE rk <= 12 END WINDOW w AS (PARTITION BY instrument ORDER BY ts, id)),
vm AS (SELECT instrument, r, median(r) OVER (PARTITION BY instrument) AS m, count(r) OVER (PARTITION BY instrument) AS n FROM vr WHERE r IS NOT NULL),
vol AS (SELECT instrument, median(abs(r - m)) AS volatility FROM vm WHERE n >= 3 GROUP BY instrument),
gp AS (SELECT instrument, median(gap) AS gap FROM (SELECT instrument, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY instrument ORDER BY ts, id)) / 1000.0 AS gap FROM s WHERE {month}) WHERE gap IS NOT NULL GROUP BY instrument),
od AS (SELECT instrument, arg_max(outlier, (ts, id)) AS outlier_driven FROM x GROUP BY instrument),
qr AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, id DESC) AS r FROM q WHERE ts <= {t}),
sup AS (SELECT instrument, max(listing_count) FILTER (WHERE r = 1) AS listing_count, max(listing_count) FILTER (WHERE r = 2) AS listing_prev, max(low_price) FILTER (WHERE r = 1) AS low_now, max(low_price) FILTER (WHERE r = 2) AS low_prev FROM qr WHERE r <= 2 GROUP BY instrument),
j AS (SELECT coalesce(od.instrument, sup.instrument) AS instrument, coalesce(n, 0) AS n, coalesce(n1, 0) AS n1, coalesce(n7, 0) AS n7, coalesce(n30, 0) AS n30, coalesce(prior7, 0) AS prior7, a.* EXCLUDE (instrument, n, n1, n7, n30, prior7), sup.* EXCLUDE (instrument), volatility AS volatility0, gap, coalesce(outlier_driven, false) AS outlier_driven
  FROM od LEFT JOIN a USING (instrument) FULL JOIN sup ON sup.instrument = od.instrument LEFT JOIN vol ON vol.instrument = od.instrument LEFT JOIN gp ON gp.instrument = od.instrument),
k AS (SELECT instrument, n, n1, n7, n30, prior7, n30 / 30.0 AS per_day, rolling_median, CASE WHEN n30 >= 3 THEN sma0 END AS sma,
  CASE WHEN len(mp) >= 3 THEN list_reduce(mp, lambda u, v: 2.0 / (len(mp) + 1) * v + (1 - 2.0 / (len(mp) + 1)) * u) END AS ema, CASE WHEN n30 >= 2 THEN gap END AS median_intersale_ms,
  CASE WHEN n7 >= 2 AND prior7 >= 2 THEN n7 / prior7 - 1 END AS volume_momentum, listing_count, listing_prev, listing_count - listing_prev AS listing_change, CASE WHEN n7 > 0 THEN listing_count / n7 END AS listing_sale_ratio,
  CASE WHEN listing_count > 0 THEN n7 / listing_count END AS absorption, last_price, (low_now - last_price) - (low_prev - second_price) AS spread_change, volatility0 AS volatility, CASE WHEN second_price > 0 THEN last_price / second_price - 1 END AS last_return,
  CASE WHEN peak > 0 THEN (peak - last_price) / peak END AS drawdown, (epoch_us({t}) - epoch_us(last_ts)) / 3.6e9 AS staleness_hours, outlier_driven, {rets} FROM j),
v0 AS (SELECT *, {okp} AS ok_periods, coalesce(ret_30d, ret_7d) AS momentum, coalesce(abs(last_return) > 0.25 AND n7 <= 1, false) AS thin_volume_spike, coalesce(last_return > 0.2 AND n7 <= 1, false) AS price_jump_without_volume FROM k),
v AS (SELECT *, coalesce(listing_change < 0 AND abs(listing_change) >= 0.5 * listing_prev AND n7 = 0, false) AS supply_disappearance, coalesce(ret_7d > 0.05 AND volume_momentum < -0.2, false) AS price_volume_divergence,
  coalesce(ret_7d > 0.1 AND n7 >= 3, false) AND NOT thin_volume_spike AND NOT price_jump_without_volume AS breakout, coalesce(drawdown > 0.2 AND coalesce(ret_7d, 0) > 0 AND n7 >= 2, false) AS reversal,
  CASE WHEN outlier_driven AND n < 5 THEN 'outlier_dependent' WHEN staleness_hours > 720 AND n > 0 THEN 'stale' WHEN n >= 8 AND ok_periods >= 3 THEN 'complete' WHEN n >= 2 THEN 'partial' ELSE 'insufficient_data' END AS quality FROM v0)"""


FLAGGED = f"{TRADES}, fm AS (SELECT id, ts, instrument, price, CASE WHEN count(*) OVER w >= 3 THEN median(price) OVER w END AS m FROM t WINDOW w AS (PARTITION BY instrument ORDER BY ts, id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)), x AS (SELECT id, ts, instrument, price, coalesce(m > 0 AND (price > m * 5 OR price < m * 0.2::DOUBLE), false) AS outlier FROM fm WHERE ts <= {A})"
VECTOR = _vector_sql(FLAGGED, QUOTES, ASOF)
LONG_VECTOR = _vector_sql(f"{DAILY}, x AS (SELECT epoch_us(ts) AS id, ts, instrument, price, false AS outlier FROM l WHERE ts <= TIMESTAMP '{LONG_ASOF}')", "q AS (SELECT 0::BIGINT AS id, TIMESTAMP '1990-01-01' AS ts, 0::BIGINT AS instrument, 0.0::DOUBLE AS low_price, 0::BIGINT AS listing_count WHERE false)", LONG_ASOF)

COUNTS = ["n", "n1", "n7", "n30", "prior7", "listing_count", "listing_change", "ok_periods"]
NUMBERS = ["per_day", "rolling_median", "sma", "ema", "median_intersale_ms", "volume_momentum", "listing_sale_ratio", "absorption", "last_price", "spread_change", "volatility", "drawdown", "staleness_hours", "momentum", *[f"ret_{p}d" for p in features.PERIODS]]
FLAGS = ["thin_volume_spike", "price_jump_without_volume", "supply_disappearance", "price_volume_divergence", "breakout", "reversal", "outlier_driven"]


def event_features(spark: SparkSession, sf: str, **more) -> DataFrame:
    return features.feature_vector(series.outlier_flags(trades(spark, sf)), quotes(spark, sf), instant(ASOF), **more)


def _digits(c: str) -> int:
    return {"median_intersale_ms": 1, "sma": 9}.get(c, 5)


@query(f"WITH {VECTOR} SELECT instrument, {', '.join(f'{c}::BIGINT AS {c}' for c in COUNTS)}, {', '.join(f'round({c}, {_digits(c)}) AS {c}' for c in NUMBERS)} FROM v")
def feature_vector_full(spark: SparkSession, sf: str) -> DataFrame:
    return event_features(spark, sf).select("instrument", *[F.col(c).cast("long").alias(c) for c in COUNTS], *[F.round(c, _digits(c)).alias(c) for c in NUMBERS])


@query(f"WITH {LONG_VECTOR} SELECT instrument, n, ok_periods::BIGINT AS ok_periods, round(staleness_hours, 5) AS staleness_hours, round(ok_periods / 6.0, 5) AS coverage, quality FROM v")
def feature_quality_state(spark: SparkSession, sf: str) -> DataFrame:
    daily = daily_trades(spark, sf).select(F.col("at").alias("id"), "at", "instrument", "price", F.lit(False).alias("outlier"))
    found = features.feature_vector(daily, quotes(spark, sf).limit(0), instant(LONG_ASOF))
    return found.select("instrument", "n", F.col("ok_periods").cast("long").alias("ok_periods"), F.round("staleness_hours", 5).alias("staleness_hours"), F.round("coverage", 5).alias("coverage"), "quality")


@query(f"WITH {VECTOR} SELECT instrument, {', '.join(FLAGS)}, quality FROM v")
def feature_manipulation_flags(spark: SparkSession, sf: str) -> DataFrame:
    return event_features(spark, sf).select("instrument", *FLAGS, "quality")


@query(f"WITH {VECTOR}, b AS (SELECT avg(ret_7d) AS bench FROM v) SELECT instrument, round(momentum, 6) AS momentum, round(momentum - bench, 6) AS relative_strength FROM v, b")
def feature_relative_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum less that of the whole market, which here is the mean 7-day return."""
    found = event_features(spark, sf).select("instrument", "momentum", "ret_7d")
    return found.join(F.broadcast(found.agg(F.avg("ret_7d").alias("bench"))), how="cross").select("instrument", F.round("momentum", 6).alias("momentum"), F.round(F.col("momentum") - F.col("bench"), 6).alias("relative_strength"))  # one row


@query(f"WITH {TRADES}, {QUOTES}, p AS (SELECT instrument, arg_max(price, (ts, id)) AS sold FROM t WHERE ts <= {A} GROUP BY 1), z AS (SELECT instrument, arg_max(low_price, (ts, id)) AS ask FROM q WHERE ts <= {A} GROUP BY 1) SELECT instrument, round(ask - sold, 6) AS spread, round(CASE WHEN sold > 0 THEN ask / sold END, 6) AS spread_ratio FROM p FULL JOIN z USING (instrument)")
def feature_ask_sold_spread(spark: SparkSession, sf: str) -> DataFrame:
    asof = instant(ASOF)
    sold = trades(spark, sf).where(F.col("at") <= asof).groupBy("instrument").agg(F.max_by("price", F.struct("at", "id")).alias("sold"))
    ask = quotes(spark, sf).where(F.col("at") <= asof).groupBy("instrument").agg(F.max_by("low_price", F.struct("at", "id")).alias("ask"))
    return sold.join(ask, "instrument", "full").select("instrument", F.round(F.col("ask") - F.col("sold"), 6).alias("spread"), F.round(F.when(F.col("sold") > 0, F.col("ask") / F.col("sold")), 6).alias("spread_ratio"))
