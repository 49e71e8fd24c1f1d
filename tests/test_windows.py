"""Extremes of windows against looking at every fact."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.windows import window_extremes

FACT, PROBE = "id long, at long, k string, price double", "id long, at long, k string, days long, high string"


def brute(probes, facts):
    out = []
    for i, at, k, days, _ in probes:
        seen = sorted((f[1], f[0], f[3]) for f in facts if k is not None and f[2] == k and days is not None and at < f[1] <= at + days)
        prices = [p for _, _, p in seen if p is not None]
        out.append((i, max(prices, default=None), min(prices, default=None), seen[-1][2] if seen else None, seen[0][2] if seen else None, len(seen)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span", [40, 100_000])
def test_against_all_facts(spark, span):
    rng = random.Random(span)
    facts = [(i, rng.randrange(-span, span), rng.choice(["a", "a", "a", "b", None]), rng.choice([None, round(rng.gauss(0, 9), 2)])) for i in range(400)]
    probes = [(i, rng.randrange(-span, span), rng.choice(["a", "a", "b", "c", None]), rng.choice([None, 0, -3, 1, 2, 3, 7, 8, 9, 31, span // 3, 3 * span]), "x") for i in range(300)]
    probes += probes[:5]
    df = spark.createDataFrame(probes, PROBE)
    held = df.select(F.struct(*df.columns).alias("p"), "k", F.col("at").alias("_from"), (F.col("at") + F.col("days")).alias("_to"))
    got = window_extremes(held, spark.createDataFrame(facts, FACT), "k", F.col("_from"), F.col("_to")).select("p.id", "high", "low", "last", "first", "n").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(probes, facts)


def test_no_facts_and_no_probes(spark):
    facts, probes = spark.createDataFrame([], FACT), spark.createDataFrame([(1, 5, "a", 3, "x")], PROBE).drop("high")
    until = F.col("at") + F.col("days")
    assert [tuple(r)[4:] for r in window_extremes(probes, facts, "k", F.col("at"), until).collect()] == [(None, None, None, None, 0)]
    assert window_extremes(probes.where("false"), facts, "k", F.col("at"), until).count() == 0
