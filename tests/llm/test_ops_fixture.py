"""Operators against brute force on small fixtures, with the awkward rows that each must bear."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import chaining, chat, embeddings, jaccard, mixing, packing, quality, suffix_dedup, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n string, size string, target string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeats within a text, blanks, nulls, non-ASCII, one long text."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 90))
    base = [" ".join(words(rng, rng.randrange(60, 200))) for _ in range(12)]
    out = list(base)
    out += [base[0]] * 4 + [base[1] + " tail", base[1]]
    for i in (2, 3):
        w = base[i].split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 30)) for _ in range(5)]
    out += ["line one of it\n" * 30, "a" * 900, "", None, "   \n\t ", "one", "two words", "two words", "é" * 300 + " ñandú " * 60, " ".join(words(rng, 6000))]
    out += ["<|endoftext|> inside", "it's they'll   spaced\n\n\n   out 123 456 !!"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 0, 1, "x", "y", "z") for i, t in enumerate(texts)]
    rows.append((5, texts[5], "en", "s1", 0, 1, "x", "y", "z"))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def all_rows(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = WORD.findall(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def classes(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_jaccard_join(spark, docs, all_rows):
    got = sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in jaccard.jaccard_join(docs, tile_rows=4).collect())
    sets = [shingles(t) for _, t, _ in all_rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = classes(pairs, len(sets))
    least = collections.defaultdict(lambda: math.inf)
    for i, (d, _, _) in enumerate(all_rows):
        least[root[i]] = min(least[root[i]], d)
    links = collections.Counter(i for p in pairs for i in p)
    assert got == sorted((d, links[i], least[root[i]], d == least[root[i]]) for i, (d, _, _) in enumerate(all_rows))
    assert jaccard.jaccard_join(empty(spark)).count() == 0


def test_bands_meet_recall():
    bands = jaccard.choose_bands(0.8, 0.999, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.999 > 1 - (1 - 0.8**6) ** (bands - 1)


def test_suffix_dedup(spark, docs, all_rows):
    for length in (200, 120):
        got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, length).collect()}
        count = collections.Counter()
        data = [t.encode() for _, t, _ in all_rows]
        for t in data:
            count.update(t[i : i + length] for i in range(len(t) - length + 1))
        want = set()
        for (d, _, _), t in zip(all_rows, data):
            gone = bytearray(len(t))
            for i in range(len(t) - length + 1):
                if count[t[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            kept = bytes(b for b, g in zip(t, gone) if not g)
            spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
            want.add((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        assert got == want
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


def test_shared_passages(spark, docs, all_rows, texts):
    found = chaining.shared_passages(docs).collect()
    text = dict((d, WORD.findall(t)) for d, t, _ in all_rows)
    for r in found:
        a, b = text[r.doc_id][r.start_word : r.end_word], text[r.ref_doc_id][r.ref_start_word : r.ref_end_word]
        assert r.ref_doc_id <= r.doc_id and len(a) >= 50
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8
    covered = {(r.doc_id, r.ref_doc_id) for r in found}
    carriers = [i for i, t in enumerate(texts) if t and t.split()[40:130] == texts[20].split()[40:130]]
    assert len(carriers) == 5
    assert {(c, carriers[0]) for c in carriers[1:]} <= covered
    assert {(12, 0), (13, 0), (14, 0), (15, 0), (16, 1), (17, 1), (18, 2), (19, 3)} <= covered
    for r in found:  # a passage is found whole
        if r.doc_id in carriers and r.ref_doc_id == carriers[0]:
            assert r.start_word <= 40 and r.end_word >= 130
    assert not {d for p in covered for d in p} & {4, 6, 7, 8, 9, 10, 11, 33}
    assert chaining.shared_passages(empty(spark)).count() == 0


def test_remove_shared_passages(spark, docs, texts):
    out = chaining.remove_shared_passages(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[0] == texts[0] and not WORD.findall(left[12]) and left[25 + 3] is None
    assert left[21].split() == texts[21].split()[:40] + texts[21].split()[130:]
    assert left[20] == texts[20] and left[33] == texts[33]
    assert chaining.remove_shared_passages(empty(spark)).count() == 0


def placed(rng, parts):
    """Texts of the parts between words of their own."""
    return [" ".join([f"a{i}x{rng.random()}" for _ in range(30)] + p + [f"z{i}x{rng.random()}" for _ in range(30)]) for i, p in enumerate(parts)]


def by_doc(spark, texts):
    found = chaining.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {d: [(r.start_word, r.end_word, r.ref_doc_id) for r in found if r.doc_id == d] for d in range(len(texts))}


def test_shared_passages_after_a_partial_quote(spark):
    rng, parts = random.Random(1), []
    for _ in range(3):
        p = words(rng, 60, 10**6)
        parts += [p[:35], p, p, p, p[20:], p]
    found = by_doc(spark, placed(rng, parts))
    for d in range(18):
        assert d % 6 > 1 or not found[d]
        assert d % 6 not in (2, 3, 5) or any(start <= 30 and end >= 90 for start, end, _ in found[d]), d


def test_shared_passages_of_frequent_lines(spark):
    """Every seed of the passage has a first carrier that lacks the passage, and so do the next ones."""
    rng = random.Random(2)
    lines = [words(rng, 24, 10**6) for _ in range(4)]
    whole = sum(lines, [])
    pieces = [whole[at : at + 40] for at in range(0, 60, 8)]
    found = by_doc(spark, placed(rng, [*pieces, whole, whole, whole]))
    n = len(pieces)
    assert not any(found[d] for d in range(n + 1))
    for d in (n + 1, n + 2):
        covered = {w for start, end, _ in found[d] for w in range(start, end)}
        assert covered >= set(range(30, 30 + len(whole))), d


def test_shared_passages_with_a_changed_word(spark):
    rng = random.Random(3)
    parts = []
    for _ in range(40):
        p = words(rng, 55, 10**6)
        parts += [p, [*p[:40], "changed", *p[41:]]]
    found = by_doc(spark, placed(rng, parts))
    assert [d for d in range(1, 80, 2) if not any(ref == d - 1 and end - start >= 50 for start, end, ref in found[d])] == []


def extended(a, b, drop=6):
    """How far word sequences stay alike along their diagonal."""
    score = best = at = 0
    for i, (x, y) in enumerate(zip(a, b)):
        score += 1 if x == y else -2
        if score > best:
            best, at = score, i + 1
        elif score < best - drop:
            break
    return at


def test_reach_bounds_likeness():
    rng = np.random.default_rng(4)
    for case in range(600):
        n, m = rng.integers(5, 120, 2)
        a, b = (rng.integers(0, 2**63, size, dtype=np.uint64) for size in (n, m))
        at, other = int(rng.integers(0, n - 4)), int(rng.integers(0, m - 4))
        for i in range(-at, n - at):  # alike around the seeds, with changes
            if 0 <= other + i < m and (0 <= i < 5 or rng.random() < 0.85):
                b[other + i] = a[at + i]
        if case % 3 == 0 and other + 25 < m:  # a word put in
            b = np.insert(b, other + 5 + int(rng.integers(0, 15)), 7)
        contexts = [chaining._contexts(x, np.array([y]), 5, np.array([0]), np.array([len(x)])) for x, y in ((a, at), (b, other))]
        left, right = (int(chaining._reach(x, y)[0]) for x, y in zip(*contexts, strict=True))
        assert left >= min(extended(a[:at][::-1], b[:other][::-1]), chaining.CONTEXT)
        assert right >= min(extended(a[at + 5 :], b[other + 5 :]), chaining.CONTEXT)


def alike_words(a, b, k=5, n=50, percent=80):
    """Words of a in windows of n words that begin and end with k words of b's window of n words and share enough k-grams with it."""
    grams = [np.array([hash(tuple(w[i : i + k])) for i in range(len(w) - k + 1)]) for w in (a, b)]
    size = n - k + 1
    if min(map(len, grams)) < size:
        return set()
    same = grams[0][:, None] == grams[1][None, :]
    total = np.zeros((same.shape[0] + 1, same.shape[1] + 1), dtype=int)
    total[1:, 1:] = same.cumsum(axis=0).cumsum(axis=1)
    both = total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]
    ends = same[: -size + 1 or None, : -size + 1 or None] & same[size - 1 :, size - 1 :]
    hits = np.flatnonzero((ends & (100 * both >= percent * (2 * size - both))).any(axis=1))
    return {w for i in hits for w in range(i, i + n)}


def edited(rng, passage, every):
    """passage with about one word in every changed, put in or left out."""
    out = []
    for i, w in enumerate(passage):
        kind = rng.randrange(3) if i % every == every // 2 else 3
        out += [[f"e{rng.random()}"], [w, f"e{rng.random()}"], [], [w]][kind]
    return out


def test_shared_passages_against_brute_force(spark):
    """All windows of all pairs of documents: partial quotes, edited copies of several kinds, recombined lines."""
    rng, parts = random.Random(6), []
    for n, every in itertools.product((55, 70, 100, 160), (30, 50, 70, 1000)):
        p = words(rng, n, 10**6)
        parts += [p[: n * 3 // 5], edited(rng, p, 15), edited(rng, p, every), p, edited(rng, p, every), p[n // 3 :], edited(rng, p, every), p]
    lines = [words(rng, 20, 10**6) for _ in range(12)]
    parts += [sum(rng.sample(lines, 4), []) for _ in range(24)]
    texts = placed(rng, parts)
    rows = chaining.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    split = [t.split() for t in texts]
    for r in rows:
        a, b = split[r.doc_id][r.start_word : r.end_word], split[r.ref_doc_id][r.ref_start_word : r.ref_end_word]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert min(len(a), len(b)) >= 50 and a[:5] == b[:5] and a[-5:] == b[-5:] and 5 * len(x & y) >= 4 * len(x | y)
    wanted = got = 0
    for d in range(len(texts)):
        want = set()
        for e in range(d):
            want |= alike_words(split[d], split[e])
        have = {w for r in rows if r.doc_id == d for w in range(r.start_word, r.end_word)}
        wanted, got = wanted + len(want), got + len(want & have)
    print("recall of words", got, wanted, got / wanted)
    assert wanted > 5000 and got >= 0.97 * wanted


def test_masked_copies(spark):
    """An earlier document holds a copy too edited to count; of two verbatim ones the later is found."""
    rng, parts = random.Random(9), []
    for n, every in ((60, 15), (100, 15), (100, 20)):
        for _ in range(40):
            p = words(rng, n, 10**6)
            parts += [[w if i % every else f"m{rng.random()}" for i, w in enumerate(p, 1)], p, p]
    found = by_doc(spark, placed(rng, parts))
    hits = [any(ref == d - 1 and start <= 30 and end >= 30 + len(parts[d]) for start, end, ref in found[d]) for d in range(2, len(parts), 3)]
    assert sum(hits) >= 0.95 * len(hits)


def test_alignment_of_long_documents():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**62, 100_000)
    b = a.copy()
    b[25::50] = rng.integers(0, 2**62, len(b[25::50]))
    b = np.delete(b, np.arange(500, 90_000, 2_000))
    out = chaining.align(a, b, np.array([[0, 25, 0]]), 5, 50, 80)
    assert sum(end - start for start, end, *_ in out) > 95_000
    assert all(like >= 0.8 for *_, like in out)
    assert chaining.align(a, rng.integers(0, 2**62, 100_000), np.array([[0, 5, 0]]), 5, 50, 80) == []


def test_shared_passages_with_string_and_null_ids(spark):
    rng = random.Random(12)
    p = words(rng, 80, 10**6)
    texts = placed(rng, [p, p, p])
    rows = list(zip([None, "b", "a"], texts))
    found = chaining.shared_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} == {("a", None), ("b", None)}


def test_chain_prefers_collinear_anchors():
    found = np.array([[0, 20, 100], [22, 40, 5], [30, 60, 130], [65, 80, 166]])
    best = chaining.chains(found)[0]
    assert best == [0, 2, 3]


def test_mixing(spark, docs, all_rows):
    rows = mixing.mix_plan(docs).collect()
    size = collections.Counter()
    for _, t, s in all_rows:
        size[s] += len(WORD.findall(t))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, left = sum(size.values()), {}, set(order)
    while True:
        spare = total - sum(target.values())
        share = {s: spare * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 3.0 * size[s] for s in over})
        left -= over
    assert len(rows) == len(all_rows)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert sorted(map(tuple, mixing.mix_plan(docs).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix_sources(empty(spark)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).cast("string")).alias("source"))
    plan = mixing.mix_plan(rows).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in plan)


def test_pack(spark, docs, all_rows):
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = [(d, np.array([*whole.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")) for d, t, _ in all_rows]
    rows = packing.pack(docs).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, own in ids:
        copies = sum(1 for e, _ in ids if e == d)
        assert sum(r.length for r in pieces[d]) == copies * len(own) and all(r.doc_tokens == len(own) for r in pieces[d])
        for r in pieces[d]:
            assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        assert sorted(i for r in pieces[d] for i in range(r.start, r.start + r.length)) == sorted(list(range(len(own))) * copies)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert sum(r.length for r in own) <= 1024
    assert sum(sum(r.length for r in own) < 1024 for own in sequences.values()) <= docs.rdd.getNumPartitions()
    assert packing.pack(empty(spark)).count() == 0


def test_packer_minimises_squares():
    rng, packer, levels = random.Random(3), packing.Packer(16), [0] * 17
    for i in range(400):
        size = rng.randrange(1, 16)
        options = {}
        for level in [0, *[h for h in range(1, 17 - size) if levels[h]]]:
            after = list(levels)
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            options[level] = sum(n * n for n in after)
        chosen = packer.choose(size)
        assert options[chosen] == min(options.values())
        packer.put((i, 0, size, np.zeros(size, dtype=np.uint32), size), size)
        levels[chosen] -= bool(chosen)
        levels[chosen + size] += chosen + size < 16
        assert levels[1:16] == packer.counts[1:16].tolist()


def test_quality_measures(spark, docs, all_rows):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measures(docs).collect())
    want = []
    for d, t, _ in all_rows:
        w = WORD.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)))
    assert got == sorted(want)
    rows = quality.quality(docs).collect()
    assert len(rows) == len(all_rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.quality(empty(spark)).count() == 0


def test_accuracies_from_votes():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    votes = np.stack([np.where(rng.random(20000) < 0.4, 0, np.where(rng.random(20000) < p, 1, -1) * np.where(truth, 1, -1)) for p in (0.95, 0.9, 0.9, 0.85)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = quality.fit_accuracies(patterns, counts)
    assert prior == pytest.approx(0.8, abs=0.04)
    assert table[0, 1, 2] / (table[0, 1, 0] + table[0, 1, 2]) == pytest.approx(0.95, abs=0.03)
    only_good = np.array([[1, 1, 1, 1], [1, 0, 1, 1], [0, 1, 1, 0]])
    prior, table = quality.fit_accuracies(only_good, np.array([900, 80, 20]))
    assert prior > 0.5 and (quality.gains(table)[:, 2] >= 0).all()


def test_equal_hashes_are_not_equal_lines():
    """Texts that collide in any polynomial hash modulo a power of two."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    (_, piece), *_ = quality.column_slices(pa.array([f"{a}\n{b}\n{a}", f"{a} {b} {b} {a} {b} {b}"]))
    m = quality.measure(piece)
    assert m["n_dup_lines"].tolist() == [1, 0] and m["n_distinct"].tolist() == [2, 2] and m["n_repeat_words"].tolist() == [0, 6]
    same = np.zeros(3, dtype=np.uint64)
    data = np.frombuffer(b"aabbaa", dtype=np.uint8)
    assert quality._later_lines(data, np.array([0, 2, 4]), np.array([2, 4, 6]), np.zeros(3, dtype=int), same).tolist() == [False, False, True]


def test_quality_agrees_with_labels(spark):
    """The posterior is nearer to labels no rule has seen than a majority of the votes, and no further than any bad vote."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    rows = quality.quality(docs).where("not base_failed").withColumns({r.name: v for r, v in zip(quality.RULES, quality._votes(quality.RULES))}).join(labels, "doc_id").collect()
    right = collections.Counter()
    for r in rows:
        votes = [r[x.name] for x in quality.RULES]
        n_bad, n_good = votes.count(-1), votes.count(1)
        for name, kept in (("posterior", r.kept), ("any", not n_bad), ("majority", n_good >= n_bad)):
            right[name] += kept == bool(r.label)
    print(len(rows), dict(right))
    assert right["posterior"] > right["majority"] and right["posterior"] >= right["any"] and right["posterior"] >= 0.99 * len(rows)


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = words(rng, 40, 2000)
        if bad:
            w[3], w[17] = rng.choice(["vile", "nasty", "awful"]), rng.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(600, None), (601, ""), (602, "vile, nasty: AWFUL!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    for i, y in labels:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    assert out[602].predicted == 1 and len(out[602].evidence) and not out[600].predicted and not out[601].predicted
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == len(rows) and {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_toxicity_against_brute_force(spark):
    """Each text's nearest examples by the cosine of all terms' weights, computed densely; string and null ids, repeated rows, ties."""
    rng, k, belief = random.Random(5), 15, 4.0
    rows, labels = [], []
    for i in range(260):
        w = words(rng, rng.choice([12, 40, 90]), 600)
        if i % 4 == 0:
            w[2], w[7] = rng.choice(["vile", "nasty"]), rng.choice(["vile", "awful"])
        rows.append((f"d{i}", " ".join(w)))
        labels.append((f"d{i}", int(i % 4 == 0)))
    rows += [("x1", None), ("x2", ""), (None, "vile nasty"), ("x3", "vile w1 w2"), ("x3", "vile w1 w2"), ("d5", rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id string, toxic int")).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(a == b for own in got.values() for a, b in itertools.pairwise(own))
    examples = [(d, t, y) for (d, t), (_, y) in zip(rows, labels) if zlib.crc32(d.encode()) % 4 != 2]
    counts = {t: collections.Counter(re.findall("[a-z]+", t or "")) for _, t in rows}
    total, frequency = len(rows), collections.Counter(w for _, t in rows for w in counts[t])
    n1, n = (collections.Counter(w for _, t, y in examples if y or every for w in counts[t]) for every in (0, 1))
    base = (sum(y for *_, y in examples) + 1) / (len(examples) + 2)
    logit = lambda p: math.log(p / (1 - p))

    def vector(t):
        out = {w: (1 + math.log(c)) * (math.log((1 + total) / (1 + frequency[w])) + 1) * abs(logit((n1[w] + belief * base) / (n[w] + belief)) - logit(base)) for w, c in counts[t].items() if n[w]}
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {w: v / norm for w, v in out.items()} if norm else {}

    vectors = [(d, vector(t)) for d, t, _ in examples]
    for d, t in rows:
        own = vector(t)
        near = sorted((round(sum(v * e.get(w, 0) for w, v in own.items()), 6) for _, e in vectors), reverse=True)[:3]
        assert got[d][0].similarity == pytest.approx([x for x in near if x > 0], abs=1e-5), d
    assert not got["x1"][0].predicted and got[None][0].predicted and got["x3"][0].predicted


def test_block_max_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(30, size=rng.integers(1, 6), replace=False)).astype(np.int64)
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, np.zeros(500), 30, block=16)
    dense = np.zeros((500, 30))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 500, 7):
        scores = dense @ dense[i]
        scores[i] = 0
        want = sorted(scores[scores > 0], reverse=True)[:10]
        near, _ = index.nearest(*vectors[i], 10, skip=i)
        assert np.allclose(near, want)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    rows = [(i, base[i % 40] + rng.normal(size=8) * (0.08 if i >= 40 else 0.1), i % 40 % 3) for i in range(120)]
    data = [(i, [float(x) for x in v], c) for i, v, c in rows]
    data += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [1.0, None] * 4, 1), (204, data[3][1], None), (205, data[3][1], data[3][2]), (206, data[3][1], data[3][2]), (207, [1e300] * 8, 0), (208, [1e-300] * 8, 0), (209, [], 0), (210, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.embedding_near_duplicates(frame, tile_rows=8).collect())
    ok = [(i, np.array(v, dtype=float) / max(map(abs, v)), c) for i, v, c in data if v and c is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.93]
    assert len(pairs) > 20
    root, links = classes(pairs, 300), collections.Counter(i for p in pairs for i in p)
    assert got == sorted((i, links[i], root[i], root[i] == i) for i, _, _ in data)
    assert embeddings.embedding_near_duplicates(frame.limit(0)).count() == 0


def test_int8_bound_is_rigorous():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes = embeddings.quantise(unit)
    exact = unit @ unit.T
    for t in (-0.2, 0.0, 0.3, 0.9):
        maybe = embeddings.possible(codes, codes, t)
        assert maybe[exact >= t].all()
        assert not maybe[exact < t - 0.1].any()


def test_edited_counts(spark, docs, all_rows):
    import base64

    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    full = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    edited = docs.withColumn("edits", token_counts.sample_edits(9))
    got = {}
    for r in token_counts.edited_counts(docs, token_counts.sample_edits(9)).collect():
        got[r.doc_id] = r
    for r in edited.collect():
        text = before = r.text or ""
        for e in r.edits:
            at = min(e["at"], len(text))
            text = text[:at] + e["insert"] + text[at + e["delete"] :]
        assert (got[r.doc_id].tokens_before, got[r.doc_id].tokens_after, got[r.doc_id].chars_after) == (len(full.encode_ordinary(before)), len(full.encode_ordinary(text)), len(text))
    assert token_counts.edited_counts(empty(spark), F.lit(None).cast("array<struct<at:long,delete:long,insert:string>>")).count() == 0


def depth(node):
    return 1 + max(depth(node.left), depth(node.right)) if node else 0


def test_count_tree_equals_full_count():
    source = token_counts.pre_tokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rng = random.Random(8)
    alphabet = ["a", "b", "'", "s", "l", " ", " ", "\n", "1", "!", "é", "word", "   ", "'ll"]
    for case in range(120):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 40, 900])))
        tree = token_counts.CountTree.of_text(text, source)
        for _ in range(12):
            at, cut, new = rng.randrange(len(text) + 2), rng.choice([0, 1, 5, 60]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 30, 400])))
            tree.edit(at, cut, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + cut :]
            pieces = source.pattern.findall(text)
            assert tree.text() == text and [p for leaf in tree.leaves() for p in leaf.pieces] == pieces
            assert [n for leaf in tree.leaves() for n in leaf.counts] == list(map(source.count, pieces))
            assert tree.total == sum(map(source.count, pieces)) and tree.length == len(text)


def test_edits_count_what_they_touch(monkeypatch):
    """A long text: the encoder sees the pre-tokens of the edits alone, the leaves stay small and the tree flat."""
    source = token_counts.pre_tokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rng = random.Random(3)
    text = " ".join(words(rng, 60_000, 10**6))
    tree = token_counts.CountTree.of_text(text, source)
    calls = []
    count = token_counts.PreTokens.count
    monkeypatch.setattr(token_counts.PreTokens, "count", lambda self, piece: calls.append(piece) or count(self, piece))
    for i in range(400):
        at, cut, new = rng.randrange(tree.length), rng.choice([0, 4, 900]), " ".join(words(rng, rng.choice([1, 3, 300])))
        at = 5000 if i % 2 else at
        seen = len(calls)
        recounted = tree.edit(at, cut, new)
        assert len(calls) - seen == recounted <= 3 * len(new.split()) + 20
        text = text[:at] + new + text[at + cut :]
    assert tree.text() == text and tree.touched < 400 * 12
    assert max(len(leaf.pieces) for leaf in tree.leaves()) <= 2 * token_counts.LEAF
    assert depth(tree.root) < 5 * math.log2(tree.root.n)


def test_stored_trees(spark, docs):
    """Trees that are stored, edited, stored and edited again count like the texts."""
    edits = F.array(F.struct(F.lit(3).alias("at"), F.lit(2).alias("delete"), F.lit(" new words").alias("insert")))
    once = token_counts.apply_edits(token_counts.build_trees(docs, edits).cache())
    twice = token_counts.apply_edits(once.select("doc_id", once.tokens_after.alias("was"), edits.alias("edits"), "leaves").cache()).collect()
    source = token_counts.pre_tokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    want = []
    for r in docs.collect():
        text = r.text or ""
        for _ in range(2):
            before, text = text, text[:3] + " new words" + text[5:]
        want.append((str(r.doc_id), *(sum(map(source.count, source.pattern.findall(t))) for t in (before, text)), text))
    got = [(str(r.doc_id), r.tokens_before, r.tokens_after, "".join(leaf.text for leaf in r.leaves)) for r in twice]
    assert sorted(got) == sorted(want)


RECORDS = [
    '{"messages":[{"role":"user","content":"hi <|turn|> & [INST]"},{"role":"assistant","content":"&lt; ok\\n<|end|>\\n"}]}',
    '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"},{"from":"odd","value":""}]}',
    '{"prompt":"p","completion":"c"}',
    '{"response":"r","prompt":"p","system":"s"}',
    '{"instruction":"i","input":"","output":"o"}',
    '{"messages":[]}',
    '{"unknown":1}',
    "no json",
    None,
]


def test_chat_layouts(spark):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "id int, record string")
    rows = {r.id: r for r in chat.format_chats(frame).collect()}
    turns = {i: [tuple(t) for t in r.turns] if r.turns is not None else None for i, r in rows.items()}
    assert turns[0] == [("user", "hi <|turn|> & [INST]"), ("assistant", "&lt; ok\n<|end|>\n")]
    assert turns[1] == [("user", "q"), ("assistant", "a"), ("odd", "")]
    assert turns[2] == [("user", "p"), ("assistant", "c")]
    assert turns[3] == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert turns[4] == [("user", "i"), ("assistant", "o")]
    assert turns[5] == [] and turns[6] is None and turns[7] is None and turns[8] is None
    assert [rows[i].layout for i in range(9)] == ["messages", "shared", "completion", "prompt", "instruction", "messages", None, None, None]
    for i in range(6):
        assert [tuple(t) for t in rows[i].read_turns] == turns[i]
        assert rows[i].loss_text == "".join(t for role, t in turns[i] if role == "assistant")
        assert not re.search(r"\[/?INST\]|</?s>", rows[i].formatted)


def test_chat_rows(spark):
    frame = spark.createDataFrame([(1, 2, "assistant", None), (1, 0, None, "a"), (1, 1, "user\nx", "bé\U0001f600"), (None, None, "assistant", "z")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.format_chats(chat.conversation_records(frame)).collect()}
    assert [tuple(t) for t in rows[1].read_turns] == [("", "a"), ("user\nx", "bé\U0001f600"), ("assistant", "")]
    assert rows[1].loss_text == "" and rows[None].loss_text == "z"
    assert chat.conversation_records(frame.limit(0)).count() == 0


def test_varied_layouts_read_back(spark):
    """Every layout is used, and what is read back is what was said, roles that look like a layout's own included."""
    said = [("user", "q <|turn|>"), ("assistant", "a & b")]
    rows = [(i, t, role, text) for i in range(60) for t, (role, text) in enumerate(said)]
    rows += [(100 + i, 0, role, "x") for i, role in enumerate(["human", "gpt", None, "user"] * 5)]
    rows += [(200 + i, t, role, "") for i in range(9) for t, role in enumerate(["user", "assistant"])]
    out = chat.format_chats(chat.varied_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {"messages", "shared", "prompt"} <= {r.layout for r in out} and len(out) == 89
    want = collections.defaultdict(list)
    for i, _, role, text in rows:
        want[i].append((role or "", text))
    assert all([tuple(t) for t in r.read_turns] == want[r.conv_id] for r in out)


def test_chat_names_may_clash(spark):
    frame = spark.createDataFrame([(1, RECORDS[0], "mine", "mine", "mine", "kept")], "id int, record string, layout string, formatted string, loss_spans string, parts string")
    row = chat.format_chats(frame).first()
    assert row.parts == "kept" and row.layout == "messages" and row.read_turns[0].role == "user"
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_jaccard_join_of_other_ids(spark):
    """String ids, nulls among them, repeated rows, texts that differ in hashes modulo powers of two alone."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [("k", "one two three four five six"), (None, "one two three four five six"), ("j", "one two three four five six"), ("j", "one two three four five six"), ("m", a), ("n", b), (None, None), (None, "alone here")]
    out = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.n_links, r.class_id or "", r.kept) for r in out) == sorted([("k", 3, "j", False), ("", 3, "j", False), ("j", 3, "j", True), ("j", 3, "j", True), ("m", 0, "m", True), ("n", 0, "n", True), ("", 0, "", True), ("", 0, "", True)])
    assert len({r.class_row for r in out}) == 5


def test_components_of_stars_and_paths(spark):
    from tidemark.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200}
