"""Point-in-time and series queries over events (trades, quotes) and line items (long histories)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import DAY, instant, trailing
from ..operators import pit, selection, series, windows
from ..session import materialised
from ..sources.tables import claims, daily_trades, events, quotes, trades
from .catalog import ASOF, DAILY, LONG_ASOF, QUOTES, TRADES, query

SEEN = f"{TRADES}, s AS (SELECT * FROM t WHERE ts <= TIMESTAMP '{ASOF}')"
W30 = f"{TRADES}, w AS (SELECT * FROM t WHERE ts > TIMESTAMP '{ASOF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{ASOF}')"


def r6(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


@query(f"WITH {SEEN} SELECT instrument, arg_max(price, (ts, id)) AS price, epoch_us(max(ts)) AS at FROM s GROUP BY instrument")
def pit_asof_latest_price(spark: SparkSession, sf: str) -> DataFrame:
    return pit.latest_asof(trades(spark, sf), ["instrument"], instant(ASOF), ["price", "at"])


@query(f"""WITH {TRADES}, c AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click')
SELECT c.event_id AS id, c.user_id AS instrument, t.price AS asof_price FROM c ASOF LEFT JOIN t ON c.user_id = t.instrument AND c.ts >= t.ts""")
def pit_asof_join_many(spark: SparkSession, sf: str) -> DataFrame:
    probes = events(spark, sf, "click").select("id", "instrument", "at")
    return pit.asof_join(probes, trades(spark, sf), "instrument", ["price"]).select("id", "instrument", "asof_price")


@query(f"""WITH {TRADES}, c AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click')
SELECT c.event_id AS id, c.user_id AS instrument, t.price AS asof_price FROM c ASOF LEFT JOIN t ON c.user_id = t.instrument AND c.ts >= t.ts""")
def pit_asof_join_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The same join with each key's rows dealt out by day, for keys that hold a large part of all rows."""
    probes = events(spark, sf, "click").select("id", "instrument", "at")
    return pit.asof_join(probes, trades(spark, sf), "instrument", ["price"], chunk=DAY).select("id", "instrument", "asof_price")


@query(f"""WITH e AS (SELECT user_id AS instrument, event_type, value, ts, event_id FROM events WHERE ts <= TIMESTAMP '2024-01-03 00:00:00'),
p AS (SELECT instrument, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS a, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS b, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'signup') AS c FROM e GROUP BY instrument)
SELECT u.instrument, coalesce(a, b, c) AS price, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 END AS choice FROM (SELECT DISTINCT user_id AS instrument FROM events) u LEFT JOIN p USING (instrument)""")
def pit_asof_preference(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [F.col("event_type") == k for k in ("purchase", "view", "signup")]
    return pit.by_preference(events(spark, sf), ["instrument"], instant("2024-01-03 00:00:00"), kinds, "price")


def _returns_sql(cte: str, source: str, asof: str, periods: tuple[int, ...], id_: str) -> str:
    parts = []
    for p in periods:
        slack = max(1.0, 0.25 * p)
        end = f"ts BETWEEN TIMESTAMP '{asof}' - INTERVAL '{int(slack * 86400)} seconds' AND TIMESTAMP '{asof}'"
        start = f"ts BETWEEN TIMESTAMP '{asof}' - INTERVAL '{int((p + slack) * 86400)} seconds' AND TIMESTAMP '{asof}' - INTERVAL {p} DAY"
        parts += [f"arg_max({id_}, (ts, {id_})) FILTER (WHERE {w}) AS {n}i{p}, arg_max(price, (ts, {id_})) FILTER (WHERE {w}) AS {n}p{p}" for n, w in (("e", end), ("s", start))]
    ok = {p: f"ei{p} IS NOT NULL AND si{p} IS NOT NULL AND ei{p} <> si{p} AND sp{p} > 0" for p in periods}
    columns = ", ".join(f"round(CASE WHEN {ok[p]} THEN ep{p} / sp{p} - 1 END, 6) AS ret_{p}d, CASE WHEN {ok[p]} THEN 'ok' ELSE 'insufficient_data' END AS status_{p}d" for p in periods)
    return f"WITH {cte}, p AS (SELECT instrument, count(*) AS n_trades, {', '.join(parts)} FROM {source} WHERE ts <= TIMESTAMP '{asof}' GROUP BY instrument) SELECT instrument, n_trades, {columns} FROM p"


def _rounded(df: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    return df.withColumns({f"ret_{p}d": F.round(f"ret_{p}d", 6) for p in periods})


SHORT, LONG = (1, 7, 14), (30, 90, 180, 365)


@query(_returns_sql(TRADES, "t", ASOF, SHORT, "id"))
def pit_return_slack_all_periods(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(pit.period_returns(trades(spark, sf), ["instrument"], instant(ASOF), SHORT), SHORT)


@query(_returns_sql(DAILY, "l", LONG_ASOF, LONG, "epoch_us(ts)"))
def pit_return_slack_long(spark: SparkSession, sf: str) -> DataFrame:
    daily = daily_trades(spark, sf).withColumn("id", F.col("at"))
    return _rounded(pit.period_returns(daily, ["instrument"], instant(LONG_ASOF), LONG), LONG)


@query(f"""WITH {TRADES}, c AS (SELECT event_id AS id, ts, user_id AS instrument, value AS start_price FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '2024-01-20 00:00:00'),
f AS (SELECT c.id, c.instrument, c.start_price, t.price / nullif(c.start_price, 0) - 1 AS r, t.price, t.ts, t.id AS tid FROM c LEFT JOIN t ON t.instrument = c.instrument AND t.ts > c.ts AND t.ts <= c.ts + INTERVAL 7 DAY)
SELECT id, instrument, count(price) AS n, round(arg_max(r, (ts, tid)), 6) AS ret, round(greatest(max(r), 0), 6) AS mfe, round(least(min(r), 0), 6) AS mae FROM f GROUP BY id, instrument""")
def pit_forward_window_mfe_mae(spark: SparkSession, sf: str) -> DataFrame:
    probes = events(spark, sf, "click").where(F.col("at") <= instant("2024-01-20 00:00:00")).select("id", "instrument", "at", F.col("price").alias("start_price"))
    met = windows.window_extremes(probes, trades(spark, sf), "instrument", F.col("at"), F.col("at") + 7 * DAY)
    r = lambda c: F.col(c) / F.nullif(F.col("start_price"), F.lit(0.0)) - 1
    found = met.select("id", "instrument", "n", r("last").alias("ret"), r("high").alias("high"), r("low").alias("low"))
    zero = lambda f, c: F.when(F.col(c).isNotNull(), f(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0))
    return found.select("id", "instrument", "n", r6("ret"), F.round(zero(F.greatest, "high"), 6).alias("mfe"), F.round(zero(F.least, "low"), 6).alias("mae"))


@query("""WITH o AS (SELECT o_custkey AS instrument, o_orderkey AS id, o_orderdate AS effective_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS effective_to FROM orders)
SELECT instrument, id FROM o WHERE effective_from <= TIMESTAMP '1998-06-30' AND (effective_to IS NULL OR effective_to > TIMESTAMP '1998-06-30')""")
def pit_valid_at(spark: SparkSession, sf: str) -> DataFrame:
    intervals = claims(spark, sf).select(F.col("forecaster").alias("instrument"), "id", F.col("at").alias("effective_from"), F.lead("at").over(series.W.partitionBy("forecaster").orderBy("at", "id")).alias("effective_to"))
    return pit.valid_at(intervals, instant("1998-06-30 00:00:00")).select("instrument", "id")


_GUARD = "2024-01-15 00:00:00"


@query(f"""WITH {TRADES}, {QUOTES}, s AS (SELECT * FROM t WHERE ts <= TIMESTAMP '{_GUARD}'), p AS (SELECT * FROM q WHERE ts <= TIMESTAMP '{_GUARD}'), l AS (SELECT instrument, arg_max(price, (ts, id)) AS price FROM s GROUP BY 1),
v AS (SELECT instrument, arg_max(low_price, (ts, id)) AS price FROM p GROUP BY 1), e AS (SELECT instrument, arg_max(id, (ts, id)) AS id, arg_max(price, (ts, id)) AS price FROM s WHERE ts >= TIMESTAMP '{_GUARD}' - INTERVAL '151200 seconds' GROUP BY 1),
b AS (SELECT instrument, arg_max(id, (ts, id)) AS id, arg_max(price, (ts, id)) AS price FROM s WHERE ts BETWEEN TIMESTAMP '{_GUARD}' - INTERVAL 7 DAY - INTERVAL '151200 seconds' AND TIMESTAMP '{_GUARD}' - INTERVAL 7 DAY GROUP BY 1)
SELECT 'latest' AS operator, count(*) AS n, round(sum(price), 3) AS total FROM l UNION ALL SELECT 'preference', count(coalesce(v.price, l.price)), round(sum(coalesce(v.price, l.price)), 3) FROM l FULL JOIN v USING (instrument)
UNION ALL SELECT 'returns', count(*), round(sum(e.price / b.price - 1), 3) FROM e JOIN b USING (instrument) WHERE e.id <> b.id AND b.price > 0 UNION ALL SELECT 'counts', count(*), sum(n) FROM (SELECT instrument, count(*) AS n FROM s WHERE ts > TIMESTAMP '{_GUARD}' - INTERVAL 7 DAY GROUP BY 1)""")
def pit_no_lookahead_guard(spark: SparkSession, sf: str) -> DataFrame:
    """As-of operators over facts of which those after the instant have been made absurd, against SQL that never sees them."""
    asof, c = instant(_GUARD), F.col
    poisoned = lambda rows, price: rows.withColumn(price, F.when(c("at") > asof, c(price) * 1000 + 1).otherwise(c(price)))
    sold, quoted = poisoned(trades(spark, sf), "price"), poisoned(quotes(spark, sf), "low_price")
    total = lambda rows, name, value: rows.agg(F.lit(name).alias("operator"), F.count(value).alias("n"), F.round(F.sum(value).cast("double"), 3).alias("total"))
    latest = pit.latest_asof(sold, ["instrument"], asof, ["price"])
    both = sold.select("id", "at", "instrument", "price", F.lit(2).alias("kind")).unionByName(quoted.select("id", "at", "instrument", c("low_price").alias("price"), F.lit(1).alias("kind")))
    preferred = pit.by_preference(both, ["instrument"], asof, [c("kind") == 1, c("kind") == 2], "price")
    returns = pit.period_returns(sold, ["instrument"], asof, [7])
    counts = sold.where(trailing(c("at"), asof, 7)).groupBy("instrument").agg(F.count("*").alias("n"))
    return total(latest, "latest", "price").unionByName(total(preferred, "preference", "price")).unionByName(total(returns, "returns", "ret_7d")).unionByName(total(counts, "counts", "n"))


@query(f"WITH {TRADES}, r AS (SELECT id, instrument, price, lag(price) OVER (PARTITION BY instrument ORDER BY ts, id) AS b FROM t) SELECT id, instrument, round(price / b - 1, 6) AS ret FROM r WHERE b > 0")
def series_trade_returns(spark: SparkSession, sf: str) -> DataFrame:
    return series.trade_returns(trades(spark, sf)).select("id", "instrument", r6("ret"))


@query(f"WITH {TRADES}, g AS (SELECT instrument, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY instrument ORDER BY ts, id) AS gap FROM t) SELECT instrument, count(gap) AS n, median(gap) AS median_us FROM g WHERE gap IS NOT NULL GROUP BY instrument")
def series_intersale_median(spark: SparkSession, sf: str) -> DataFrame:
    gaps = materialised(series.gaps(trades(spark, sf)))
    return gaps.groupBy("instrument").agg(F.count("*").alias("n")).join(selection.group_medians(gaps, ["instrument"], "gap", "median_us"), "instrument")


def _month(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).where(trailing(F.col("at"), instant(ASOF), 30))


@query(f"WITH {W30} SELECT instrument, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN avg(price) END, 6) AS sma FROM w GROUP BY instrument")
def series_sma_30d(spark: SparkSession, sf: str) -> DataFrame:
    return _month(spark, sf).groupBy("instrument").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 3, F.avg("price")), 6).alias("sma"))


@query(f"WITH {W30}, a AS (SELECT instrument, list(price ORDER BY ts, id) AS p FROM w GROUP BY instrument) SELECT instrument, round(CASE WHEN len(p) >= 3 THEN list_reduce(p, lambda x, y: 2.0 / (len(p) + 1) * y + (1 - 2.0 / (len(p) + 1)) * x) END, 6) AS ema FROM a")
def series_ema_30d(spark: SparkSession, sf: str) -> DataFrame:
    found = _month(spark, sf).groupBy("instrument").agg(series.ordered("price").alias("p"))
    return found.select("instrument", F.round(series.ema(F.col("p")), 6).alias("ema"))


@query(f"WITH {W30} SELECT instrument, round(median(price), 6) AS rolling_median FROM w GROUP BY instrument")
def series_rolling_median_30d(spark: SparkSession, sf: str) -> DataFrame:
    return selection.group_medians(_month(spark, sf), ["instrument"], "price").select("instrument", F.round("median", 6).alias("rolling_median"))


def _near_trades(rows: DataFrame, asof: Column) -> DataFrame:
    """Each instrument's trades of the last 7 days and its last 12, in order, as h; the rest of its history isn't gathered."""
    rank = F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("at"), F.desc("id")))
    near = (F.col("at") > asof - 7 * DAY) | (F.col("_rank") <= 12)
    seen = rows.where(F.col("at") <= asof).withColumn("_rank", rank)
    return seen.groupBy("instrument").agg(F.array_sort(F.collect_list(F.when(near, F.struct("at", "id", "price")))).alias("h"))


@query(f"""WITH {SEEN}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, id DESC) AS rn, ts > TIMESTAMP '{ASOF}' - INTERVAL 7 DAY AS recent, count(*) FILTER (WHERE ts > TIMESTAMP '{ASOF}' - INTERVAL 7 DAY) OVER (PARTITION BY instrument) AS n FROM s),
c AS (SELECT * FROM k WHERE CASE WHEN n >= 3 THEN recent ELSE rn <= 12 END),
r AS (SELECT instrument, price / lag(price) OVER (PARTITION BY instrument ORDER BY ts, id) - 1 AS r, lag(price) OVER (PARTITION BY instrument ORDER BY ts, id) AS b FROM c),
m AS (SELECT instrument, r, median(r) OVER (PARTITION BY instrument) AS m, count(*) OVER (PARTITION BY instrument) AS n FROM r WHERE b > 0)
SELECT i.instrument, round(x.mad, 6) AS volatility FROM (SELECT DISTINCT instrument FROM s) i LEFT JOIN (SELECT instrument, median(abs(r - m)) AS mad FROM m WHERE n >= 3 GROUP BY instrument) x USING (instrument)""")
def series_mad_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """MAD of trade returns over the last 7 days, or over the last 12 trades where those hold under 3."""
    asof = instant(ASOF)
    found = _near_trades(trades(spark, sf), asof)
    recent = F.filter("h", lambda x: x["at"] > asof - 7 * DAY)
    chosen = F.transform(F.when(F.size(recent) >= 3, recent).otherwise(F.slice(F.col("h"), F.greatest(F.size("h") - 11, F.lit(1)), F.lit(12))), lambda x: x["price"])
    steps = F.filter(F.zip_with(F.slice(chosen, F.lit(2), F.greatest(F.size(chosen) - 1, F.lit(1))), F.slice(chosen, F.lit(1), F.greatest(F.size(chosen) - 1, F.lit(1))), lambda now, before: F.when(before > 0, now / before - 1)), lambda r: r.isNotNull())
    return found.select("instrument", F.round(series.array_mad(F.when(F.size(chosen) > 1, steps).otherwise(F.array().cast("array<double>"))), 6).alias("volatility"))


@query(f"WITH {TRADES} SELECT instrument, round(max(price), 6) AS peak, round(arg_max(price, (ts, id)), 6) AS last, round((max(price) - arg_max(price, (ts, id))) / max(price), 6) AS drawdown FROM t GROUP BY instrument")
def series_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return series.drawdown(trades(spark, sf)).select("instrument", r6("peak"), r6("last"), r6("drawdown"))


@query(f"WITH {TRADES}, d AS (SELECT instrument, epoch_us(date_trunc('day', ts)) // 86400000000 AS day, arg_max(price, (ts, id)) AS close FROM t GROUP BY ALL) SELECT instrument, day, round(close, 6) AS close, round(close / lag(close) OVER (PARTITION BY instrument ORDER BY day) - 1, 6) AS ret FROM d")
def series_daily_close_returns(spark: SparkSession, sf: str) -> DataFrame:
    return series.daily_close(trades(spark, sf)).select("instrument", "day", r6("close"), r6("ret"))


@query(f"""WITH {TRADES}, {QUOTES}, a AS (SELECT instrument, price, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, id DESC) AS r FROM t), b AS (SELECT instrument, low_price, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, id DESC) AS r FROM q),
x AS (SELECT instrument, max(price) FILTER (WHERE r = 1) AS p1, max(price) FILTER (WHERE r = 2) AS p2 FROM a GROUP BY 1), y AS (SELECT instrument, max(low_price) FILTER (WHERE r = 1) AS l1, max(low_price) FILTER (WHERE r = 2) AS l2 FROM b GROUP BY 1)
SELECT instrument, round((l1 - p1) - (l2 - p2), 6) AS spread_change FROM x FULL JOIN y USING (instrument)""")
def series_last_two(spark: SparkSession, sf: str) -> DataFrame:
    a = series.last_two(trades(spark, sf), "instrument", "price").toDF("instrument", "p1", "p2")
    b = series.last_two(quotes(spark, sf), "instrument", "low_price").toDF("instrument", "l1", "l2")
    return a.join(b, "instrument", "full").select("instrument", F.round((F.col("l1") - F.col("p1")) - (F.col("l2") - F.col("p2")), 6).alias("spread_change"))


@query(f"""WITH {TRADES}, m AS (SELECT id, instrument, price, CASE WHEN count(*) OVER w >= 3 THEN median(price) OVER w END AS m FROM t WINDOW w AS (PARTITION BY instrument ORDER BY ts, id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT id, instrument, round(m, 6) AS median_before, coalesce(m > 0 AND (price > m * 5 OR price < m * 0.2::DOUBLE), false) AS outlier FROM m""")
def series_outlier_flag_prior7(spark: SparkSession, sf: str) -> DataFrame:
    return series.outlier_flags(trades(spark, sf)).select("id", "instrument", r6("median_before"), "outlier")


@query(f"""WITH {TRADES}, v AS (SELECT instrument, price, row_number() OVER (PARTITION BY instrument ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n, min(price) OVER (PARTITION BY instrument) AS lo, max(price) OVER (PARTITION BY instrument) AS hi FROM t),
xy AS (SELECT *, floor(CASE WHEN n = 1 THEN 0.0::DOUBLE ELSE i / (n - 1)::DOUBLE * 160.0::DOUBLE END * 10 + 0.5::DOUBLE)::BIGINT AS x, floor((36.0::DOUBLE - (price - lo) / CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE hi - lo END * 36.0::DOUBLE) * 10 + 0.5::DOUBLE)::BIGINT AS y FROM v)
SELECT instrument, count(*) AS points, string_agg(CASE WHEN i = 0 THEN 'M' ELSE 'L' END || (x // 10) || '.' || (x % 10) || ',' || (y // 10) || '.' || (y % 10), ' ' ORDER BY i) AS path FROM xy GROUP BY instrument""")
def series_sparkline_path(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path, of as many points as the instrument has trades: the drawing is the gathered history."""
    found = trades(spark, sf).groupBy("instrument").agg(series.ordered("price").alias("p"))
    return found.select("instrument", F.size("p").cast("long").alias("points"), series.sparkline(F.col("p")).alias("path"))
