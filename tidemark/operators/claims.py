"""Claims: extraction from text, price at the claim, outcome, early score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import ascii_edges
from ..functions.stats import ladder
from ..functions.times import DAY
from .pit import asof_join
from .windows import window_extremes

# Phrases of each direction, tried in this order.
BULLISH = ("will go up", "going up", "i would buy", r"\bbuy\b", "undervalued", r"target\s*\$", "上がる", "買う")
BEARISH = ("sell now", r"\bsell\b", "overpriced", "going down", "will drop", "下がる", "売る")
AVOID = (r"\bavoid\b", "stay away")
WATCH = ("keep an eye", r"\bwatch\b")
NON_CLAIM = ("i pulled", "this card exists", r"price is \$", "just a pull")
# Phrases of each horizon, tried in this order.
HORIZONS = {
    "365d": r"\b365\s*d\b|\b1\s*year\b|\ba year\b",
    "180d": r"\b180\s*d\b|\b6\s*months?\b",
    "90d": r"\b90\s*d\b|\b3\s*months?\b",
    "30d": r"\b30\s*d\b|\b30\s*days?\b|\b1\s*month\b|\ba month\b",
    "7d": r"\b7\s*d\b|\b7\s*days?\b|\ba week\b|\b1\s*week\b",
    "custom": r"\b\d+\s*days?\b|\bin two weeks\b",
}


# Patterns of the numbers that a claim states.
DAYS, TWO_WEEKS, CODE_DAYS = r"(?i)\b(\d+)\s*days?\b", "(?i)two weeks", r"(\d+)"
TARGET, DOLLARS = r"(?i)target\s*\$?\s*([0-9]+(?:\.[0-9]+)?)", r"\$\s*([0-9]+(?:\.[0-9]+)?)"
PERCENT, CONFIDENCE = r"([0-9]+(?:\.[0-9]+)?)\s*%", r"(?i)\b([0-9]{1,3})\s*%\s*(?:sure|confident)"


def any_of(phrases: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(phrases)


def direction(text: Column) -> Column:
    """Direction of the first list with a hit; null for what is no claim."""
    hit = lambda phrases: text.rlike(ascii_edges(any_of(phrases)))
    found = ladder([(hit(BULLISH), "bullish"), (hit(BEARISH), "bearish"), (hit(AVOID), "avoid"), (hit(WATCH), "watch")], None)
    return F.when(~hit(NON_CLAIM), found)


def horizon(text: Column) -> Column:
    return ladder([(text.rlike(ascii_edges("(?i)" + p)), code) for code, p in HORIZONS.items()], "unspecified")


#: Days of the longest horizon that is taken for one.
MOST_DAYS = 3650


def horizon_days(text: Column, code: Column) -> Column:
    """Days of a horizon code; of a custom one, the number in the text, else two weeks. Null for a number beyond MOST_DAYS, however long it is."""
    number = F.regexp_extract(text, ascii_edges(DAYS), 1)
    days = F.when(F.length(F.ltrim(number, F.lit("0"))) <= 9, number.try_cast("int"))
    custom = F.when(number != "", F.when(days <= MOST_DAYS, days)).when(text.rlike(TWO_WEEKS), 14)
    return F.when(code == "custom", custom).when(code != "unspecified", F.regexp_extract(code, CODE_DAYS, 1).try_cast("int"))


def _number(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, ascii_edges(pattern), 1)
    return F.when(found != "", found.try_cast("double"))


def target_price(text: Column) -> Column:
    return F.coalesce(_number(text, TARGET), _number(text, DOLLARS))


def target_percent(text: Column) -> Column:
    return _number(text, PERCENT)


def stated_confidence(text: Column) -> Column:
    stated = _number(text, CONFIDENCE) / 100
    return F.when(stated <= 1, stated)


def outcome(claims: DataFrame, trades: DataFrame, asof: Column) -> DataFrame:
    """claims with status, ending_price, ret, verdict, target_hit, mfe and mae.

    claims: id, instrument, at, direction, start_price, days, target_price. Later trades within the horizon are
    looked up by instrument and time; each claim keeps its row, equal ones as well."""
    end = F.col("at") + F.col("days").cast("long") * DAY
    held = claims.select(F.struct(*claims.columns).alias("_claim"), "instrument", F.col("at").alias("_from"), end.alias("_to"))  # so that no column of claims can clash
    met = window_extremes(held, trades, "instrument", F.col("_from"), F.col("_to"))
    found = met.select("_claim.*", F.col("last").alias("ending_price"), F.col("high").alias("_high"), F.col("low").alias("_low"))
    missing = F.col("instrument").isNull() | F.col("start_price").isNull() | F.col("days").isNull()
    status = ladder([(missing, "insufficient_data"), (end > asof, "pending"), (F.col("ending_price").isNull(), "missing_market_data")], "evaluated")
    done = F.col("status") == "evaluated"
    move = lambda c: F.when(done, (F.col(c) - F.col("start_price")) / F.nullif(F.col("start_price"), F.lit(0.0)))
    sign = F.when(F.col("direction") == "bullish", 1).when(F.col("direction") == "bearish", -1)
    found = found.withColumn("status", status).withColumn("ret", move("ending_price"))
    verdict = ladder([(~done, None), (sign.isNull(), "not_applicable"), (sign * F.col("ret") > 0.005, "correct"), (sign * F.col("ret") < -0.005, "incorrect")], "flat")
    hit = F.when(F.col("direction") == "bullish", F.col("ending_price") >= F.col("target_price")).when(F.col("direction") == "bearish", F.col("ending_price") <= F.col("target_price"))
    return found.withColumns({"verdict": verdict, "target_hit": F.when(done, hit), "mfe": F.when(done, F.greatest(move("_high"), F.lit(0.0))), "mae": F.when(done, F.least(move("_low"), F.lit(0.0)))}).drop("_high", "_low")


def early_score(claims: DataFrame, trades: DataFrame, days: int = 7) -> DataFrame:
    """claims with pre_move: from the first trade of the days before the claim to its start price, and early = ret - pre_move."""
    held = claims.select(F.struct(*claims.columns).alias("_claim"), "instrument", F.col("at").alias("_to"))
    met = window_extremes(held, trades, "instrument", F.col("_to") - days * DAY, F.col("_to"))
    found = met.select("_claim.*", F.col("first").alias("_first"))
    pre = F.when(F.col("_first") > 0, (F.col("start_price") - F.col("_first")) / F.col("_first"))
    return found.withColumn("pre_move", pre).withColumn("early", F.col("ret") - F.col("pre_move")).drop("_first")


def price_at(claims: DataFrame, trades: DataFrame, references: DataFrame, key: str = "instrument") -> DataFrame:
    """claims with price and price_source: the newest trade at or before each, else the newest reference.

    A newest trade without a price falls through to the reference. Two carried as-of joins, both by key."""
    found = asof_join(claims, trades, key, ["price"], "_trade_")
    found = asof_join(found, references, key, ["price"], "_reference_")
    source = F.when(F.col("_trade_price").isNotNull(), "trade").when(F.col("_reference_price").isNotNull(), "reference")
    return found.withColumns({"price": F.coalesce("_trade_price", "_reference_price"), "price_source": source}).drop("_trade_price", "_reference_price")


def evidence_tags(text: Column) -> Column:
    """Names of what a text states: direction, horizon, target price, target percent, confidence."""
    stated = {"direction": direction(text).isNotNull(), "horizon": horizon(text) != "unspecified", "target_price": target_price(text).isNotNull(), "target_percent": target_percent(text).isNotNull(), "confidence": stated_confidence(text).isNotNull()}
    return F.array_compact(F.array(*[F.when(there, name) for name, there in stated.items()]))


EXTRACTED = "direction string, horizon string, target_price double, confidence double"


def validated(raw: Column) -> Column:
    """An extracted claim in JSON as a struct, null if it is malformed or any field is out of its range."""
    c = F.from_json(raw, EXTRACTED)
    ok = c["direction"].isin("bullish", "bearish", "avoid", "watch") & c["horizon"].isin(*HORIZONS, "unspecified")
    ok = ok & (c["target_price"].isNull() | (c["target_price"] > 0)) & (c["confidence"].isNull() | c["confidence"].between(0, 1))
    return F.when(F.coalesce(ok, F.lit(False)), c)
