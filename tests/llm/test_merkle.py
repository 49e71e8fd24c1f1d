"""Merkle manifests against a plain reading of the contract."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.merkle import FIELDS, fold, leaf_digest, merkle_proofs, siblings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path string, _g string, root int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def beside(tree, i, arity):
    out = []
    for nodes in tree[:-1]:
        first = i // arity * arity
        out += [n for j, n in enumerate(nodes[first : first + arity], first) if j != i]
        i //= arity
    return out


def brute(rows, arity):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, h("".join(encoded(r[c]) for c in FIELDS)), r["doc_id"]))
    langs = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: levels([x[2] for x in sorted(by[lang], key=lambda x: x[:3])], arity) for lang in langs}
    top = levels([trees[lang][-1][0] for lang in langs], arity) if langs else None
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, leaf, doc) in enumerate(sorted(by[lang], key=lambda x: x[:3])):
            out.append((doc, leaf, trees[lang][-1][0], top[-1][0], "".join(beside(trees[lang], i, arity) + beside(top, k, arity))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, f"text {i}", rng.choice(["en", "en", "en", "de", "é", "z\U0001f600"]), f"s{i % 3}", i, "a", "b", "c", 1) for i in range(333)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, "x", None, None, None, "a", "b", "c", 1), (1000, "", "only", "s", 2**63 - 1, "a", "b", "c", 1), (-5, "x:1", "", "", 0, "a", "b", "c", 1)]
    rows += [(7, "twice", "en", "s", 5, "a", "b", "c", 1)] * 9 + [(2000, "long é" * 200_000, "en", "s", 5, "a", "b", "c", 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("arity", "height"), [(2, 6), (2, 2), (3, 2), (5, 1)])
def test_proofs_against_brute_force(docs, arity, height):
    out = merkle_proofs(docs, arity=arity, height=height)
    got = out.select("doc_id", "leaf", "subroot", "root", F.array_join(siblings(F.col("path")), "").alias("s"), fold(F.col("leaf"), F.col("path")).alias("f")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute([r.asDict() for r in docs.collect()], arity)
    assert all(r.f == r.root for r in got)


def test_a_changed_field_changes_the_folded_root(docs):
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    out = merkle_proofs(docs, altered={"n_chars": changed}).select("doc_id", (fold(F.col("altered_leaf"), F.col("path")) == F.col("root")).alias("same")).collect()
    assert len(out) == docs.count()
    assert all(r.same == (r.doc_id is None or r.doc_id % 3 != 0) for r in out)


def test_no_rows_and_one_row(spark, docs):
    assert merkle_proofs(docs.where("false")).count() == 0
    one = merkle_proofs(docs.where("doc_id = 1000")).first()
    assert one.leaf == one.subroot == one.root
    assert one.path == []


def test_order_and_group_of_other_types(spark):
    rows = spark.createDataFrame([("b", 2, 1.5), ("a", 1, None), ("c", 2, 2.5)], "name string, part int, score double")
    out = merkle_proofs(rows, fields=("name", "score"), group="part", order="name").collect()
    assert {r.name: r.leaf for r in out} == {n: h(encoded(n) + encoded(s)) for n, s in (("a", None), ("b", 1.5), ("c", 2.5))}
    assert len({r.root for r in out}) == 1


def test_fields_cannot_run_into_each_other(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("1:a", None), ("-", "")], "x string, y string")
    assert rows.select(leaf_digest([F.col("x"), F.col("y")])).distinct().count() == 4
