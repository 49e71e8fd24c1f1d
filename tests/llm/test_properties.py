"""Properties on generated inputs, without Spark."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chaining, packing, suffix_dedup
from tidemark.llm.textops import RangeHash, TextSlice, column_slices

TEXT = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sll12<|endoftext|>é")), max_size=80)
IDS = packing.token_ids(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_fast_ids_are_the_tokenizers_ids(text):
    assert IDS(text).tolist() == IDS.slow(text).tolist()


def test_special_tokens_go_through_tokenizers():
    assert 50256 in IDS("a <|endoftext|> b").tolist()


def slices(texts, limit):
    for first, piece in column_slices(pa.array(texts, pa.string()), limit):
        yield first, piece


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 200))
def test_words_do_not_depend_on_slices(texts, limit):
    got = [[] for _ in texts]
    for first, piece in slices(texts, limit):
        start, end, docs = piece.words()
        for s, e, d in zip(start, end, docs):
            got[first + d].append(bytes(piece.data[s:e]))
    want = [[w for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.integers(0, 40))
def test_range_hash_does_not_depend_on_place(data, shift):
    a = RangeHash(np.frombuffer(data, dtype=np.uint8))
    b = RangeHash(np.frombuffer(b"x" * shift + data + b"y", dtype=np.uint8))
    n = len(data)
    assert a.of(np.array([0]), np.array([n])) == b.of(np.array([shift]), np.array([shift + n]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 12))
def test_sliding_min(values, width):
    x = np.array(values, dtype=np.uint64)
    want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert suffix_dedup.sliding_min(x, width).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=420), min_size=1, max_size=5))
def test_phrases_cover_every_window_once(texts):
    for _, piece in slices(texts, 1 << 20):
        docs, first, last, trigger, _, _ = suffix_dedup.phrases(piece, 200)
        starts = sorted(p for a, b in zip(first, last) for p in range(a, b + 1))
        want = [p for d in range(piece.n_docs) for p in range(piece.offsets[d], piece.offsets[d + 1] - 199)]
        assert starts == want
        assert ((trigger >= last) & (trigger - first <= 200 - suffix_dedup.TAIL)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
def test_chains_are_collinear_and_disjoint(points):
    word, other = (np.array(x, dtype=np.int64) for x in zip(*points))
    found = chaining.anchors(word, other, 5)
    chains = chaining.chains(found)
    assert sorted(i for c in chains for i in c) == list(range(len(found)))
    for c in chains:
        for i, j in zip(c, c[1:]):
            assert found[i, 1] <= found[j, 0] and found[i, 2] + found[i, 1] - found[i, 0] <= found[j, 2]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 5)), min_size=1, max_size=6))
def test_kept_bytes(text, spans):
    spans = [(a, a + n) for a, n in spans if a + n + 10 <= len(text)]
    if not spans:
        return
    first, last = (np.array(x) for x in zip(*spans))
    removed, kept = suffix_dedup.kept_bytes(text, first, last, 10)
    gone = bytearray(len(text))
    for a, b in spans:
        gone[a : b + 10] = b"\1" * (b + 10 - a)
    assert hashlib.sha256(b"".join(text[a:b] for a, b in kept)).digest() == hashlib.sha256(bytes(c for c, g in zip(text, gone) if not g)).digest()
    assert sum(b - a for a, b in removed) == sum(gone)


def test_slice_of_no_documents():
    assert list(column_slices(pa.array([], pa.string()))) == []
    assert TextSlice(np.zeros(0, dtype=np.uint8), np.array([0, 0])).words()[0].tolist() == []
