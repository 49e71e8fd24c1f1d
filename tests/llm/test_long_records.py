"""One long record each: texts, edits and conversations of many parts; and words written to share a hash."""

import collections
import random
import re
import time

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, jaccard, quality
from tidemark.llm.textops import RangeHash, TextSlice
from tidemark.llm.token_counts import CountTree, pre_tokens
from tidemark.llm.toxicity import toxicity

SAME_HASH = ("zxdmytankitspiyu", "nfospjnkFR;1PH8B")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def piece(*texts):
    data = [t.encode() for t in texts]
    return TextSlice(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))


def test_the_words_share_a_hash_without_a_secret():
    data = np.frombuffer("".join(SAME_HASH).encode(), dtype=np.uint8)
    start, end = np.array([0, 16]), np.array([16, 32])
    a, b = RangeHash(data).of(start, end)
    assert a == b
    a, b = RangeHash(data, (5, 9)).of(start, end)
    assert a != b


def test_words_of_one_hash_repeat_nothing():
    x, y = SAME_HASH
    text = " ".join(f"{w} a{i} b{i}" for i in range(20) for w in (x, y))
    repeats = collections.Counter(tuple(WORD.findall(text)[i : i + 3]) for i in range(118))
    w = WORD.findall(text)
    covered = {i + j for i in range(len(w) - 2) if repeats[tuple(w[i : i + 3])] > 1 for j in range(3)}
    m = quality.measure(piece(text, "again " + text))
    assert m["n_repeat_words"].tolist() == [len(covered), len(covered)]
    assert m["n_distinct"].tolist() == [42, 43]


def test_words_of_one_hash_make_no_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(1000)}" if i % 2 else None for i in range(60)]
    rows = [(i, " ".join(w or SAME_HASH[i] for w in words)) for i in range(2)]
    out = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n_links, r.kept) for r in out] == [(0, True)] * 2


def test_repeats_of_a_long_text():
    rng = random.Random(1)
    w = [f"w{rng.randrange(300)}" for _ in range(300_000)]
    w[100:160] = w[200_000:200_060]
    count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    m = quality.measure(piece("short one", " ".join(w)))
    assert m["n_repeat_words"].tolist() == [0, len(covered)]
    assert m["n_words"].tolist() == [2, 300_000]


def test_near_copies_and_scores_of_a_long_text(spark):
    rng = random.Random(1)
    w = [f"w{rng.randrange(3000)}" for _ in range(200_000)]
    other = [*w[:100_000], "changed", *w[100_001:]]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other)), (3, "short text here")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in jaccard.jaccard_join(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 4)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity(docs, labels).where("score between 0 and 1").collect()} == {1, 2, 3}


@pytest.fixture(scope="module")
def source():
    return pre_tokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def test_edits_of_a_long_text(source):
    rng = random.Random(5)
    text = " ".join(rng.choice(["alpha", "beta", "it's", "12 34", "\n\n", "é"]) for _ in range(300_000))
    edits = [(1000, 900_000, "mid dle"), (0, 5, ""), (700_000, 400_000, "x" * 50), (10, 0, " put in" * 1000)]
    tree = CountTree.of_text(text, source)
    began = time.time()
    for at, delete, insert in edits:
        at, delete = min(at, len(text)), min(delete, len(text) - min(at, len(text)))
        tree.edit(at, delete, insert)
        text = text[:at] + insert + text[at + delete :]
        assert tree.text() == text
    assert tree.total == sum(map(source.count, source.pattern.findall(text)))
    tree = CountTree.of_text(text * 20, source)
    tree.edit(0, tree.length, "")
    assert (tree.total, tree.length) == (0, 0)
    assert time.time() - began < 60


def test_many_small_edits_against_counting_anew(source):
    rng = random.Random(9)
    text = " ".join(rng.choice(["alpha", "it's", "12", "\n", "  ", "é!", "a" * 40]) for _ in range(2000))
    tree = CountTree.of_text(text, source)
    for _ in range(300):
        at, delete = rng.randrange(len(text) + 1), rng.choice([0, 1, 3, 50, 2000])
        insert = rng.choice(["", " ", "x", "\n\n", "new words here", "'s"])
        tree.edit(at, delete, insert)
        text = text[:at] + insert + text[at + delete :]
        assert tree.text() == text
        assert tree.total == sum(map(source.count, source.pattern.findall(text)))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_places_of_sizes(spark, n):
    sizes = [i % 7 for i in range(n)]
    df = spark.createDataFrame([(sizes,)], "s array<bigint>")
    expected = [sum(sizes[:i]) for i in range(n)]
    assert df.select(chat.begins(F.col("s"))).first()[0] == expected


def test_a_conversation_of_many_turns(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<[&"), F.col("id")).alias("text"))
    began = time.time()
    out = chat.format_chats(chat.conversation_records(rows)).select(F.size("read_turns").alias("n"), F.col("read_turns")[n - 1]["text"].alias("last"), F.sha2("loss_text", 256).alias("loss"), F.size("loss_spans").alias("spans")).first()
    assert (out.n, out.last, out.spans) == (n, f"é<[&{n - 1}", n // 2)
    assert out.loss == __import__("hashlib").sha256("".join(f"é<[&{i}" for i in range(1, n, 2)).encode()).hexdigest()
    assert time.time() - began < 60
