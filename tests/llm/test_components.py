"""Connected components take no more rounds, and so no more of the driver, than they need."""

import random

import pytest

from tidemark.llm.components import components


def test_stars_need_no_round(spark):
    edges = [(1, 5), (6, 1), (1, 7), (2, 9), (3, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), max_rounds=0).collect())
    assert got == {1: 1, 5: 1, 6: 1, 7: 1, 2: 2, 9: 2, 3: 3}


@pytest.mark.parametrize("edges", [[(1, 5), (5, 9)], [(1, 5), (2, 5)]])
def test_what_is_no_star_of_its_least_node_needs_one(spark, edges):
    rows = spark.createDataFrame(edges, "a long, b long")
    with pytest.raises(RuntimeError):
        components(rows, max_rounds=0)
    assert {r.component for r in components(rows).collect()} == {1}


def test_random_edges_against_union_find(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(-150, 150), draw.randrange(-150, 150)) for _ in range(160)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, top(x)) for x in root)
