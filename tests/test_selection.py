"""Medians of groups against sorting each."""

import random
import statistics

import pytest

from tidemark.operators.selection import group_mads, group_medians


def expected(rows):
    by = {}
    for k, j, v in rows:
        by.setdefault((k, j), []).append(v)
    out = {}
    for key, values in by.items():
        some = [v for v in values if v is not None]
        m = statistics.median(some) if some else None
        out[key] = (m, statistics.median([abs(v - m) for v in some]) if some else None)
    return out


@pytest.mark.parametrize(("gather", "split"), [(4096, 64), (8, 8), (50, 3)])
def test_against_sorting(spark, gather, split):
    rng = random.Random(gather)
    rows = [(rng.choice(["a", "a", "a", None]), rng.randrange(2), rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 40), -5.0, 7.0])) for _ in range(1500)]
    rows += [("same", 0, 3.0)] * 500 + [("two", 0, 1.0)] * 300 + [("two", 0, 2.0)] * 300 + [("one", 1, 4.5), ("none", 1, None), ("some", 1, None), ("some", 1, 1.0)]
    frame = spark.createDataFrame(rows, "k string, j int, v double").repartition(3)
    got = {(r.k, r.j): r.median for r in group_medians(frame, ["k", "j"], "v", gather=gather, split=split).collect()}
    assert got == {k: m for k, (m, _) in expected(rows).items()}
    if gather == 8:
        mads = {(r.k, r.j): (r.median, r.mad) for r in group_mads(frame, ["k", "j"], "v", gather, split).collect()}
        assert mads == expected(rows)


def test_no_rows(spark):
    assert group_medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0
