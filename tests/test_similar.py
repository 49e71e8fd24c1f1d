"""Joins of names alike against all pairs."""

import random

import pytest

from tidemark.operators.similar import similar_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def similarity(a, b):
    if a == b:
        return 1.0
    x, y = ({w for w in t.split(" ") if w} for t in (a, b))
    edit = 1 - distance(a, b) / max(len(a), len(b))
    return max(edit, 2.0 * len(x & y) / (len(x) + len(y)) if x or y else 0.0)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 26))) for _ in range(40)]
    base += [" ".join(rng.choice(["red", "blue", "ring", "of", "the", "moon", "x"]) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    out = list(base)
    for name in base:
        letters = list(name)
        for _ in range(rng.randrange(0, 5)):
            at, kind = rng.randrange(len(letters) + 1), rng.randrange(3)
            if kind == 0:
                letters.insert(at, rng.choice("abcdé "))
            elif kind == 1 and len(letters) > 1:
                letters.pop(min(at, len(letters) - 1))
            else:
                letters[min(at, len(letters) - 1)] = rng.choice("abcdé")
        out.append("".join(letters))
    return [*out, "", None, "a", " ", "grennja", "greninja"]


@pytest.mark.parametrize("least", [0.78, 0.5, 0.9, 1.0])
def test_against_all_pairs(spark, least):
    a, b = corpus(1), corpus(2) + corpus(1)[::2]
    got = similar_names(spark.createDataFrame([(x,) for x in a + a[:5]], "name string"), spark.createDataFrame([(x,) for x in b], "other string"), least).collect()
    expected = {(x, y): similarity(x, y) for x in set(a) for y in set(b) if x and y and similarity(x, y) >= least}
    assert len(got) == len(expected)
    assert {(r.name, r.other) for r in got} == set(expected)
    assert all(abs(r.sim - expected[r.name, r.other]) < 1e-12 for r in got)


def test_nothing_to_meet(spark):
    none = spark.createDataFrame([], "name string")
    assert similar_names(none, none.withColumnRenamed("name", "other"), 0.78).count() == 0
