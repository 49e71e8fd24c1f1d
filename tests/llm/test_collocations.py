"""Phrase collocations against a plain count of all phrases."""

import collections
import random
import re

import pytest

from tidemark.llm import collocations as module
from tidemark.llm.collocations import collocations, phrase_counts

SCHEMA = "text string, lang string, phrase string, n string, f int, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, max_words):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def brute(rows, max_words=3, min_count=10, top=2000, percent=50, scale=1_000_000):
    f, n = counted(rows, max_words)
    c = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= min_count}
    longer = collections.Counter()
    for (lang, w), v in c.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], v)
    out = []
    for (lang, w), a in c.items():
        if longer[lang, w] * 100 >= percent * a and longer[lang, w]:
            continue
        score, _, left, right = min((scale * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    rows, place = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            rows.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return rows


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "a b", "W1", "x\x01y", "\U0001f600", "a"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = []
    for _ in range(300):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 80))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", " hot pair "]) for w in words)
        out.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    out += [(None, "en"), ("", "en"), (" \t\n", None), (None, None), (".,;:", "de"), ("hot pair " * 5000, "en"), ("w0", "one")]
    out += [("again and again the same", "de")] * 12
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(t, lang, "x", "y", 1, 2) for t, lang in rows], SCHEMA).repartition(7)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_against_brute_force(docs, rows):
    assert got(collocations(docs)) == sorted(brute(rows))


def test_longer_phrases_lower_bounds_and_ties(docs, rows, small_batches):
    """Runs go on over batches and tasks, and the filter lets every word through."""
    out = collocations(docs, max_words=5, min_count=4, top=7, contained_percent=80, scale=1000, filter_bits=8)
    assert got(out) == sorted(brute(rows, 5, 4, 7, 80, 1000))


def test_all_counts(docs, rows, small_batches):
    f, n = counted(rows, 3)
    phrases, totals = phrase_counts(docs, min_count=3)
    assert {(r.lang, r.phrase): r.f for r in phrases.collect()} == {(lang, " ".join(w)): v for (lang, w), v in f.items() if v >= 3}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_text_longer_than_a_slice(spark, monkeypatch):
    """A long text is cut behind breaks; a piece longer than a slice is handled whole."""
    monkeypatch.setattr(module, "SLICE_BYTES", 50)
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "b", "c"]) + rng.choice(["", "", "", "."]) for _ in range(400)) + " a b" * 100
    piece = module.TextSlice(module.np.frombuffer(text.encode(), dtype=module.np.uint8), module.np.array([0, len(text)]))
    f = collections.Counter()
    for part in module._parts(piece):
        codes, _, words = module._words(part)
        f.update(words.to_pylist()[c] for c in codes)
    assert len(list(module._parts(piece))) > 3
    assert f == collections.Counter({w[0]: v for (_, w), v in counted([(text, "en")], 1)[0].items()})


def test_no_rows_and_nothing_frequent(spark, docs):
    assert got(collocations(docs.where("false"))) == []
    few = spark.createDataFrame([("only once here", "en", "", "", 0, 0)], SCHEMA)
    assert got(collocations(few)) == []


def test_runs_over_batches_and_parts_over_tasks():
    """Runs go on over batches; counts of phrases of hot words are parts that add up over tasks."""
    rng = random.Random(3)
    rows = [" ".join(rng.choice(["a", "a", "a", "b", "c"]) for _ in range(rng.choice([2, 3]))) for _ in range(400)]
    hot = {"a", "b"}

    def n_hot(pointer):
        words = pointer.split()
        return next((i for i, w in enumerate(words) if w not in hot), len(words))

    dealt = collections.defaultdict(list)
    for p in rows:
        dealt[hash(tuple(p.split()[: n_hot(p) + 1])) % 3].append(p)
    total = collections.Counter()
    for own in dealt.values():
        own.sort()
        batches = [module.pa.RecordBatch.from_arrays([module.pa.array([n_hot(p) for p in x]), module.pa.array(["en"] * len(x)), module.pa.array(x), module.pa.array([1] * len(x))], names=["prefix", "lang", "pointer", "n"]) for x in (own[i : i + 11] for i in range(0, len(own), 11))]
        for b in module._grow(3, 10)(iter(batches)):
            for r in b.to_pylist():
                total[r["phrase"]] += r["f"]
    expected = collections.Counter()
    for p in rows:
        w = p.split()
        for m in range(2, len(w) + 1):
            expected[" ".join(w[:m])] += 1
    assert {k: v for k, v in total.items() if v >= 10} == {k: v for k, v in expected.items() if v >= 10}
