"""Sets and residual names of texts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.signals import residual_name, sets_in_texts


@pytest.mark.parametrize("pass_sets", [1000, 7])
def test_sets_in_texts_against_looking_for_each(spark, pass_sets):
    rng = random.Random(3)
    sets = [(i * 3, f"k{i}", rng.choice(["Twilight", "Masque", "Sv", "Ünder", "a.b"]) + f" {i % 13}") for i in range(40)]
    texts = [(i, " ".join(rng.choice(["see", "TWILIGHT 3", "masque 1", "k7", "xk12y", "a.b 4", "ünder 9", "sv"]) for _ in range(rng.randrange(6)))) for i in range(60)]
    texts += [(98, None), (99, ""), (5, texts[5][1])]
    got = sets_in_texts(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(sets, "place long, set_key string, name string"), pass_sets).collect()
    expected = [(i, [p for p, k, n in sets if t and (n.lower() in t.lower() or k in t.lower())]) for i, t in texts]
    assert sorted((r.id, [s.place for s in r.sets]) for r in got) == sorted(expected)


def test_no_sets(spark):
    texts = spark.createDataFrame([(1, "some text")], "id long, text string")
    none = spark.createDataFrame([], "place long, set_key string, name string")
    assert sets_in_texts(texts, none).first().sets == []


def test_residual_name(spark):
    rows = spark.createDataFrame([("Japanese Twilight Masquerade Greninja 214/167 reverse holo TWM",), ("plain",), ("promo en 12 13",)], "text string")
    sets = spark.createDataFrame([(0, "twm", "Twilight Masquerade")], "place long, set_key string, name string")
    got = [r.x for r in sets_in_texts(rows, sets).orderBy("text").select(residual_name(F.col("text"), F.col("sets")).alias("x")).collect()]
    assert got == ["Greninja", "plain", "13"]
