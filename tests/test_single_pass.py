"""Facts are read and shuffled once, whatever number of dates or slices is asked for."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import authority, pit
from tidemark.plans import market


@pytest.fixture
def exchanges(spark, capsys):
    """The number of shuffles by hash in a plan without broadcasts."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)

    def count(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out.count("Exchange hashpartitioning")

    yield count
    for k in settings:
        spark.conf.unset(k)


def test_latest_at_several_instants(spark):
    facts = spark.createDataFrame([("a", 1, 5.0), ("a", 10, 6.0), ("a", 11, None), ("a", 30, 7.0), ("b", 20, 8.0), ("c", 31, 9.0)], "k string, at long, price double")
    got = {r.k: (r["values"], r.days) for r in pit.latest_at(facts, "k", [F.lit(10), F.lit(20), F.lit(30)], "price").collect()}
    # a newest fact without a price gives none
    assert got == {"a": ([6.0, None, 7.0], [2, 3, 4]), "b": ([None, 8.0, 8.0], [0, 1, 1])}


def test_index_return_reads_prices_of_all_dates_together(spark, capsys):
    """Prices are scanned once for both levels."""
    market.index_return(spark, "/root/testdata/sf0.001").explain()
    assert capsys.readouterr().out.count("l_extendedprice:double") == 1


@pytest.fixture
def calls(spark):
    rows = [(f, i, "g" if i % 2 else None, "en", "s", str(i % 3), "7d", ("correct", "incorrect", "flat")[i % 3], None if i % 7 == 0 else float((i * 37) % 11), None, 0.5) for f, n in ((1, 4), (2, 9), (None, 12), (3, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "f int, at long, game string, language string, set_key string, tier string, horizon string, verdict string, ret double, relative double, confidence double")


@pytest.mark.parametrize("gather", [0, 5, 100])
def test_medians_are_the_same_for_forecasters_of_few_and_many_calls(spark, calls, gather):
    trust = spark.createDataFrame([(1, "excluded")], "f int, trust string")
    got = authority.slices(calls, trust, "f", F.lit(100), gather=gather).where("game = '*'").collect()
    want = {}
    for r in calls.collect():
        want.setdefault(r.f, []).append(r.ret)
    some = {f: [x for x in xs if x is not None] for f, xs in want.items()}
    assert {r.f: (r.calls, r.median_return) for r in got} == {f: (len(want[f]), median(xs) if xs else None) for f, xs in some.items()}


def test_calls_of_few_are_shuffled_once(spark, calls, exchanges):
    trust = spark.createDataFrame([(1, "excluded")], "f int, trust string")
    assert exchanges(authority.slices(calls, trust, "f", F.lit(100))) <= 2
