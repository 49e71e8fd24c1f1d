"""Edge cases of the operators that the test tables don't hold: ties, nulls, empty inputs, later facts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys, stats
from tidemark.functions.times import DAY
from tidemark.operators import accounts, claims, content, features, forecast, indices, ingest, pit, relational, resolve, scoring, series
from tidemark.plans import point_in_time
from tidemark.streaming import ingest as streaming

TRADE = "id long, at long, instrument long, price double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_asof_takes_the_newest_row_even_without_a_price(spark):
    facts = spark.createDataFrame([(1, 10, 1, 5.0), (2, 20, 1, None), (3, 30, 1, 9.0), (4, 10, 2, 1.0), (5, 10, 2, 2.0)], TRADE)
    got = {r.instrument: r.price for r in pit.latest_asof(facts, ["instrument"], F.lit(25), ["price"]).collect()}
    assert got == {1: None, 2: 2.0}  # ties go to the larger id


def test_asof_join_carries_and_keeps_unmatched_probes(spark):
    facts = spark.createDataFrame([(1, 10, 1, 5.0), (2, 20, 1, None), (3, 30, 1, 9.0)], TRADE)
    probes = spark.createDataFrame([(7, 9, 1), (8, 10, 1), (9, 29, 1), (10, 99, 1), (11, 50, 2)], "id long, at long, instrument long")
    for chunk in (None, 1, 7, 1000):
        got = {r.id: r.asof_price for r in pit.asof_join(probes, facts, "instrument", ["price"], chunk=chunk).collect()}
        assert got == {7: None, 8: 5.0, 9: None, 10: 9.0, 11: None}
    assert pit.asof_join(probes.limit(0), facts, "instrument", ["price"]).count() == 0


def test_forward_window_is_open_then_closed(spark):
    facts = spark.createDataFrame([(1, 10, 1, 5.0), (2, 20, 1, 6.0), (3, 21, 1, 7.0)], TRADE)
    claim = spark.createDataFrame([(1, 10, 1)], "id long, at long, instrument long")
    row = pit.forward_window(claim, facts, "instrument", 10, [F.count("f_price").alias("n"), F.max("f_price").alias("m")]).first()
    assert (row.n, row.m) == (1, 6.0)


def test_equal_claims_stay_apart(spark):
    facts = spark.createDataFrame([(1, 10, 1, 5.0), (2, 25, 1, 6.0)], TRADE)
    claim = spark.createDataFrame([(1, 8, 1), (1, 8, 1), (2, 99, 1)], "id long, at long, instrument long")
    rows = pit.forward_window(claim, facts, "instrument", 20, [F.count("f_price").alias("n")]).collect()
    assert sorted((r.id, r.n) for r in rows) == [(1, 2), (1, 2), (2, 0)]


def test_health_takes_each_branch(spark):
    from tidemark.operators import accounts

    kinds = "activated boolean, created boolean, recent int, usage int, lim int, failed boolean, endpoints int, failing int, billing string, adopted int"
    rows = [
        ((True, True, 0, 0, 0, False, 0, 0, "active", 4), (100, 20, 30, 80, 60, 100, 100, 70)),
        ((False, True, 2, 5, 0, True, 2, 0, "trialing", 1), (40, 70, 70, 35, 100, 100, 25, 63)),
        ((False, False, 9, 0, 10, False, 3, 2, "past_due", 0), (0, 100, 25, 80, 50, 30, 0, 41)),
        ((True, True, 1, 5, 10, False, 9, 6, "canceled", 2), (100, 55, 70, 80, 0, 10, 50, 52)),
        ((True, True, 1, 12, 10, False, 1, 1, None, 2), (100, 55, 55, 80, 75, 50, 50, 66)),
    ]
    frame = spark.createDataFrame([r for r, _ in rows], kinds).coalesce(1)
    scores = accounts.health(*[F.col(c) for c in ("activated", "created", "recent", "usage", "lim", "failed", "endpoints", "failing", "billing", "adopted")])
    assert [tuple(r) for r in frame.select(*[c.alias(k) for k, c in scores.items()]).collect()] == [want for _, want in rows]


def test_returns_need_two_different_trades(spark):
    day = DAY
    facts = spark.createDataFrame([(1, 100 * day, 1, 10.0), (2, 107 * day, 1, 12.0), (3, 107 * day, 2, 4.0), (4, 100 * day, 3, 0.0), (5, 107 * day, 3, 1.0)], TRADE)
    got = {r.instrument: (r.status_7d, r.ret_7d) for r in pit.period_returns(facts, ["instrument"], F.lit(107 * day), [7]).collect()}
    assert got[1][0] == "ok" and got[1][1] == pytest.approx(0.2)
    assert got[2] == got[3] == ("insufficient_data", None)


def test_series_functions(spark):
    array = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, series.ema(array(1, 2, 4))) == 2.75
    assert one(spark, series.ema(array(1, 2))) is None
    assert one(spark, series.array_median(array(3, 1, 2, 10))) == 2.5
    assert one(spark, series.array_mad(array(1, 2, 6))) == 1
    assert one(spark, series.array_mad(array(1, 2))) is None
    assert one(spark, series.sparkline(array(1, 3))) == "M0.0,36.0 L160.0,0.0"
    assert one(spark, series.sparkline(array(5))) == "M0.0,36.0"


def test_outlier_needs_three_trades_before(spark):
    rows = [(i, i, 1, 40.0) for i in range(3)] + [(3, 3, 1, 400.0), (4, 4, 1, 7.0)]
    got = [r.outlier for r in series.outlier_flags(spark.createDataFrame(rows, TRADE)).orderBy("id").collect()]
    assert got == [False, False, False, True, True]


def test_feature_states(spark):
    day = DAY
    rows = [(i, (100 + i) * day, 1, 50.0 + i, False) for i in range(40)] + [(100, 139 * day, 2, 40.0, True)]
    trades = spark.createDataFrame(rows, TRADE + ", outlier boolean")
    quotes = spark.createDataFrame([(1, 139 * day, 3, 9.0, 4)], "id long, at long, instrument long, low_price double, listing_count long")
    got = {r.instrument: r for r in features.feature_vector(trades, quotes, F.lit(139 * day)).collect()}
    assert got[1].n30 == 30 and got[1].drawdown == 0 and got[1].ret_30d == pytest.approx(89 / 59 - 1) and got[1].quality == "complete"
    assert got[2].n == 0 and got[2].outlier_driven and got[2].quality == "outlier_dependent" and got[2].last_price is None
    assert got[3].n7 == 0 and got[3].listing_count == 4 and got[3].quality == "insufficient_data"
    again = features.feature_vector(trades.unionByName(spark.createDataFrame([(999, 141 * day, 1, 1.0, False)], trades.schema)), quotes, F.lit(139 * day)).where("instrument = 1").first()
    assert again == got[1]  # a later trade changes nothing


def test_statistics(spark):
    assert one(spark, stats.wilson_low(F.lit(0), F.lit(0))) == 0 and one(spark, stats.wilson_high(F.lit(0), F.lit(0))) == 1
    assert one(spark, stats.half_up(F.lit(-2.5))) == -2
    assert one(spark, stats.clamp(F.lit(None).cast("double"))) is None
    assert one(spark, stats.trust_state(F.lit(60), F.lit(0.7))) == "trusted"
    assert one(spark, stats.price_tier(F.lit(None).cast("double"))) == "unknown"


def test_keys(spark):
    assert one(spark, keys.key_of(keys.cursor(F.lit("a?b>c")))) == "a?b>c"
    assert one(spark, keys.fingerprint(F.lit('{"b":1,"a":{"d":2,"c":3}}'))) == one(spark, keys.fingerprint(F.lit('{"a":{"c":3,"d":2},"b":1}')))
    assert one(spark, keys.stable_id("x_", F.lit("a"), F.lit(None))) != one(spark, keys.stable_id("x_", F.lit(None), F.lit("a")))
    rows = spark.createDataFrame([(" Ｆｕｌｌ  Width ",), (None,)], "t string").select(keys.normalized_name(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["full width", None]


def test_scores_renormalise(spark):
    part = scoring.parts({"a": 0.6, "b": 0.4}, {"a": F.lit(None), "b": F.lit(80)})
    assert one(spark, scoring.combine(part)) == 80
    explained = one(spark, scoring.explain(part))
    assert explained[0].skipped_reason == "missing_input" and explained[1].applied_weight == 1
    assert one(spark, scoring.combine(scoring.parts({"a": 1.0}, {"a": F.lit(None)}))) == 50


def test_timeline_keeps_the_weight_of_those_who_stay(spark):
    dated = spark.createDataFrame([("x", 1, 0, 0.5), ("x", 1, 1, 0.4), ("x", 1, 3, 0.2), ("x", 2, 1, 0.6)], "index_key string, instrument long, step int, weight double")
    dates = spark.createDataFrame([(0, 10), (1, 20), (2, 30), (3, 40)], "step int, at long")
    got = {tuple(r) for r in indices.timeline(dated, dates).collect()}
    assert got == {("x", 1, 0.5, 10, 30), ("x", 1, 0.2, 40, None), ("x", 2, 0.6, 20, 30)}


def test_claims(spark):
    text = spark.createDataFrame([("Buy: target $12.5 in 14 days, 70% sure",), ("nothing",)], "t string")
    c = F.col("t")
    rows = text.select(claims.direction(c).alias("d"), claims.horizon(c).alias("h"), claims.horizon_days(c, claims.horizon(c)).alias("n"), claims.target_price(c).alias("p"), claims.stated_confidence(c).alias("s")).collect()
    assert tuple(rows[0]) == ("bullish", "custom", 14, 12.5, 0.7)
    assert tuple(rows[1]) == (None, "unspecified", None, None, None)


def test_relational(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, x string")
    assert rows.where(relational.conjunction(x=None)).count() == 1
    assert rows.where(relational.conjunction(x=relational.UNSET)).count() == 3
    with pytest.raises(ValueError):
        relational.for_tenant(rows, None, "id")
    page = relational.keyset_page(rows, "id", 1, 1).collect()
    assert [(r.id, r.has_more) for r in page] == [(2, True)]
    assert relational.keyset_page(rows, "id", 3, 5).count() == 0
    accepted, refused = relational.route(rows, F.when(F.col("x").isNull(), "no_x"))
    assert accepted.count() == 2 and refused.first().reason == "no_x"


def test_ingest(spark):
    rows = spark.createDataFrame([("k", 1, "f"), ("k", 2, "f"), ("k", 3, "g")], "key string, seq int, fp string")
    assert [r.verdict for r in ingest.dedup_conflicts(rows, ["key"], "fp", ["seq"]).orderBy("seq").collect()] == ["new", "duplicate", "conflict"]
    assert one(spark, ingest.first_failure([("a", F.lit(True)), ("b", F.lit(None).cast("boolean"))])) == "b"
    assert "[redacted]" in one(spark, ingest.redact(F.lit("my Password and sk_live")))


def test_resolution(spark):
    assert one(spark, resolve.name_similarity(F.lit("red ring"), F.lit("ring red"))) == 1
    assert one(spark, resolve.edit_similarity(F.lit(""), F.lit(""))) == 0
    ranked = spark.createDataFrame([(1, 10, 0.95, 1), (1, 11, 0.7, 2), (2, 10, 0.8, 1), (2, 11, 0.79, 2)], "id int, target long, score double, rank int")
    assert {tuple(r) for r in resolve.decide(ranked, "target").collect()} == {(1, "high_confidence", 10), (2, "ambiguous", None)}


def test_accounts(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, industry string")
    assert rows.where(accounts.segment([("industry", "eq", "")])).count() == 1
    assert rows.where(accounts.segment([])).count() == 0
    state = {k: one(spark, c) for k, c in accounts.retry(F.lit(3), F.lit(503), F.lit(8)).items()}
    assert state == {"status": "pending", "delay_s": 240, "disabled": True}


def test_json_ingest(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("{",), ('{"a": "' + "x" * 70000 + '"}',)], "value string")
    got = [r.reason for r in streaming.json_events(raw, "a string").collect()]
    assert got == [None, "malformed", "too_large"]


def test_volatility_gathers_recent_trades_only(spark):
    asof = 100 * DAY
    rows = [(i, i * DAY // 10, 1, float(i)) for i in range(990)] + [(i, i * DAY // 100, 2, 1.0) for i in range(2000, 2500)] + [(3000, asof + 1, 3, 1.0), (3001, 98 * DAY, 4, None)]
    found = point_in_time._near_trades(spark.createDataFrame(rows, "id long, at long, instrument long, price double"), F.lit(asof)).collect()
    ids = {r.instrument: [x.id for x in r.h] for r in found}
    assert ids == {1: list(range(931, 990)), 2: list(range(2488, 2500)), 4: [3001]}


def test_mentions_resolve_over_the_whole_catalog(spark):
    """The cases that a resolver must tell apart: typos alone, typos with fields, ids that contradict, nothing given."""
    entry = "target string, concept string, names array<string>, game string, set_key string, number string, language string, variant string, rarity string, finish string, promo boolean, external string"
    rows = [(f"g_{lang}_{v}", "greninja", ["greninja", "gekkouga"], "pokemon", "twm", "214/167", lang, v, "sr", None, False, f"tcc_{lang}_{v}") for lang in ("en", "ja") for v in ("normal", "holo")]
    rows += [("c_en", "charizard", ["charizard"], "pokemon", "sv1", "006", "en", "normal", None, None, False, None), ("l_en", "luffy", ["luffy"], "onepiece", "op01", "001", "en", "normal", None, None, True, "tcc_luffy")]
    catalog = spark.createDataFrame(rows, entry)
    full = {"game": "pokemon", "set_key": "twm", "number": "214/167", "language": "en", "variant": "normal"}
    cases = {
        "typo": ({"game": "pokemon", "name": "grennja"}, "probable", None, "greninja"), "typo alone": ({"name": "grennja"}, "probable", None, "greninja"), "typo full": ({**full, "name": "grennja"}, "exact", "g_en_normal", "greninja"), "typo high": ({**full, "game": None, "name": "grennja"}, "high_confidence", "g_en_normal", "greninja"),
        "name": ({"name": "greninja"}, "ambiguous", None, "greninja"), "no variant": ({**full, "variant": None}, "ambiguous", None, "greninja"), "full": (full, "exact", "g_en_normal", "greninja"), "empty": ({}, "unresolved", None, None), "unknown": ({"name": "pikachu"}, "unresolved", None, None),
        "conflict": ({"language": "en", "external": "tcc_ja_normal"}, "conflict", None, "greninja"), "id": ({"external": "tcc_ja_normal"}, "exact", "g_ja_normal", "greninja"), "id of another game": ({"game": "pokemon", "external": "tcc_luffy"}, "ambiguous", None, None), "language alone": ({"language": "en"}, "ambiguous", None, None),
        "typo and language": ({"name": "charizrd", "language": "en"}, "high_confidence", "c_en", "charizard"), "wrong finish": ({**full, "finish": "matte"}, "exact", "g_en_normal", "greninja"),
    }
    names = ["name", "game", "set_key", "number", "language", "variant", "rarity", "finish", "external", "content_language"]
    mentions = spark.createDataFrame([(k, *[g.get(n) for n in names], None, None) for k, (g, *_) in cases.items()], "id string, " + ", ".join(f"{n} string" for n in names) + ", promo boolean, context boolean")
    got = {r["id"]: (r.status, r.target, r.concept) for r in resolve.statuses(mentions, catalog).collect()}
    assert got == {k: tuple(v[1:]) for k, v in cases.items()}


def test_replays_are_duplicates_and_null_keys_stay(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "x", 2), ("a", "y", 3), (None, "x", 1), (None, "x", 2)], "key string, fp string, seq int")
    got = sorted((r.key or "", r.seq, r.verdict) for r in ingest.dedup_conflicts(rows, ["key"], "fp", ["seq"]).collect())
    assert got == [("", 1, "new"), ("", 2, "duplicate"), ("a", 1, "duplicate"), ("a", 1, "new"), ("a", 2, "duplicate"), ("a", 3, "conflict")]


def test_states_of_replayed_records(spark):
    catalog = spark.createDataFrame([(1, "b", "e1")], "target int, brand string, external string")
    rows = [(0, "q", None, "f0"), (0, "q", None, "f0"), (1, "q", "b", "f1"), (2, "q", "b", "f1"), (3, "q", None, "f0"), (4, "q", "b", "f2"), (0, "r", None, "f"), (1, "r", None, "f")]
    feed = spark.createDataFrame([(s, k, b, fp, None) for s, k, b, fp in rows], "seq int, key string, brand string, fp string, external string")
    got = sorted((r.key, r.seq, r.state, r.reason, r.target) for r in ingest.record_states(feed, catalog, ["key"], "fp", ["seq"], ["brand"], ["brand"]).collect())
    quarantined = ("quarantined", "concept_only", None)
    assert got == [("q", 0, *quarantined), ("q", 0, *quarantined), ("q", 1, "processed", None, 1), ("q", 2, "duplicate", None, None), ("q", 3, "revision", None, None), ("q", 4, "revision", None, None), ("r", 0, *quarantined), ("r", 1, *quarantined)]


def test_a_median_of_zero_flags_nothing(spark):
    rows = spark.createDataFrame([(i, i, 1, p) for i, p in enumerate([0.0, 0.0, 0.0, 5.0])], "id long, at long, instrument int, price double")
    assert not any(r.outlier for r in series.outlier_flags(rows).collect())


def test_drafts_are_checked_against_their_own_evidence(spark):
    source = "array<struct<type:string,id:string>>"
    evidence = spark.createDataFrame([(1, "en", "en", "k-en-1", False, False, [("a", "s1"), ("b", "s2")]), (2, "ja", "en", "k-en-2", False, True, [("a", "s3")]), (3, None, None, None, None, False, [])], f"evidence int, language string, identity_language string, identity_key string, comparative boolean, thin boolean, sources {source}")
    rows = [(10, 1, "email", "v1", "x" * 120, "<p>"), (11, 1, "card_analysis", " ", "x" * 399, "<p><script>"), (12, 2, "email", "v1", "short", None), (13, 3, "email", "v1", None, "<p>"), (14, 9, "email", "v1", "x", "<p>")]
    drafts = spark.createDataFrame(rows, "draft int, evidence int, output_type string, generator_version string, body_text string, body_html string")
    claims_ = spark.createDataFrame([(10, "a", "s1"), (10, "b", "s2"), (11, "b", "s3"), (11, "a", None), (12, "a", "s3"), (77, "a", "s1")], "draft int, claim_key string, source_id string")
    got = {r.draft: (r.failures, r.passed) for r in content.draft_failures(drafts, claims_, evidence).collect()}
    assert got == {
        10: ([], True), 11: (["model_version_missing", "min_substance", "unresolved_claim:a", "unresolved_claim:b", "unsafe_html", "min_substance"], False), 12: (["stub_too_short", "language_mismatch", "cross_language_merge"], False),
        13: (["min_substance", "numeric_claims_missing"], False), 14: (["evidence_missing"], False),
    }


def test_a_text_of_a_long_number_ends_no_job(spark):
    texts = ["buy, hold 99999999999 days", "hold 45 days", "hold 0000000045 days", "hold 4000 days", "target $" + "9" * 400, "two weeks, " + "1" * 80 + "% sure"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    got = rows.select(claims.horizon_days(text, claims.horizon(text)).alias("d"), claims.target_price(text).alias("p"), claims.stated_confidence(text).alias("c")).collect()
    assert [r.d for r in got] == [None, 45, 45, None, None, None]


def test_a_mention_meets_groups_of_entries_and_not_each(spark):
    """What mentions meet doesn't grow with entries that they can't tell apart; pools still count every entry, and ids still name their own."""
    entry = "target int, concept string, names array<string>, game string, set_key string, number int, language string, variant string, rarity string, finish string, promo boolean, external string"
    same = [(i, "ring", ["red ring"], "g", "s", i % 40, "en", "normal", "rare", "matte" if i % 2 else "gloss", False, f"x{i}") for i in range(400)]
    catalog = spark.createDataFrame([*same, (400, "ring", ["red ring"], "g", None, 7, "en", "normal", None, None, None, None), (401, None, ["bolt"], None, "s", 1, None, None, None, None, None, "x401")], entry)
    none = {k: None for k in ("name", "external", "content_language", "context", *resolve.HARD, *resolve.SOFT)}
    given = [{"name": "red rng", "set_key": "s"}, {"name": "red rng", "number": 7, "game": "g"}, {"set_key": "s", "language": "en", "external": "x9"}, {"name": "red rng", "set_key": "s", "number": 7, "finish": "matte"}, {"set_key": "s", "number": 1}]
    mentions = spark.createDataFrame([{"id": i, **none, **g} for i, g in enumerate(given)], "id int, name string, external string, content_language string, context boolean, game string, set_key string, number int, language string, variant string, rarity string, finish string, promo boolean")
    assert resolve._met(mentions, catalog).count() <= 20
    got = {r["id"]: (r.status, r.target, r.concept, r.pool) for r in resolve.statuses(mentions, catalog).collect()}
    assert got == {0: ("ambiguous", None, "ring", 400), 1: ("probable", None, "ring", 11), 2: ("exact", 9, "ring", 400), 3: ("ambiguous", None, "ring", 10), 4: ("ambiguous", None, None, 11)}


def test_equal_names_of_a_block_are_compared_once(spark):
    """Ranks over many equal candidates, against all pairs: by score, ties by target, nulls nowhere."""
    names = ["red ring", "red rang", "ring red", "blue bolt", None]
    rows = [(i, i % 2, names[i % 5]) for i in range(150)]
    catalog = spark.createDataFrame(rows, "target int, block int, candidate string")
    mentions = spark.createDataFrame([*rows, (900, None, "red ring")], "id int, block int, name string")
    pairs = mentions.join(catalog, "block").withColumn("score", resolve.name_similarity(F.col("name"), F.col("candidate"))).where("score >= 0.5").collect()
    expected = set()
    for i in {p["id"] for p in pairs}:
        best = sorted((-p.score, p.target) for p in pairs if p["id"] == i)[:12]
        expected |= {(i, t, -s, r) for r, (s, t) in enumerate(best, 1)}
    found = resolve.fuzzy_candidates(mentions, catalog, ["block"], "target")
    assert {tuple(r) for r in found.collect()} == expected
    assert len(expected) == 120 * 12


def test_returns_on_a_close_of_zero(spark):
    """As SQL divides: infinite on 0, NaN from 0 to 0, null on no price."""
    prices = [0.0, 5.0, 0.0, 0.0, None, 2.0, 4.0]
    rows = spark.createDataFrame([(i, i * DAY, 1, p) for i, p in enumerate(prices)], TRADE)
    got = [r.ret for r in series.daily_close(rows).orderBy("day").collect()]
    assert [str(x) for x in got] == ["None", "inf", "-1.0", "nan", "None", "None", "1.0"]


def test_forecasts_from_a_price_of_zero_are_evaluated(spark):
    rows = spark.createDataFrame([(0.0, 3.0, 4.0, 2.0), (0.0, 0.0, 0.0, 0.0), (2.0, 3.0, 4.0, 1.0), (2.0, None, None, None), (None, 3.0, 4.0, 2.0)], "start double, last double, peak double, trough double")
    c = F.col
    made = forecast.evaluation(c("start"), c("last"), c("peak"), c("trough"), F.lit(0.1), F.lit(0.0), F.lit(1.0), F.lit(0.6))
    got = rows.select(*[x.alias(k) for k, x in made.items()]).collect()
    assert [str(r.actual) for r in got] == ["inf", "nan", "0.5", "None", "None"]
    assert [r.direction_correct for r in got] == [True, True, True, None, None] and [r.range_hit for r in got] == [False, False, True, None, None]


def test_weights_add_up_exactly(spark):
    """0.1 + 0.2 is 0.3: scores that are all 65 have a mean of 65 and stay within a bound of 65."""
    weights = {"a": 0.1, "b": 0.2, "c": 0.7}
    assert one(spark, scoring.combine(scoring.parts(weights, {"a": F.lit(65.0), "b": F.lit(65.0), "c": F.lit(None)}))) == 65.0


def test_used_units_do_not_hang_on_the_order_of_rows(spark):
    amounts = [0.1, 0.2, 0.3, 98.9, 1e9, -1e9]
    rows = [(k, x) for k, order in enumerate([amounts, amounts[::-1], amounts[2:] + amounts[:2]]) for x in order] + [(9, 99.49), (8, None)]
    found = accounts.used_units(spark.createDataFrame(rows, "k int, x double").coalesce(1), "k", "x")
    assert {r.k: r.used for r in found.collect()} == {0: 1, 1: 1, 2: 1, 9: 0, 8: None}


def test_records_are_shuffled_by_their_key_alone(spark, capsys):
    """Each side of the join deals its rows out once, by the key; counting and the join shuffle nothing more."""
    rows = spark.range(100).selectExpr("id % 10 key", "cast(id as string) fp", "id % 3 seq")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ingest.dedup_conflicts(rows, ["key"], "fp", ["seq"]).explain()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert 1 <= plan.count("Exchange hashpartitioning") <= 2
