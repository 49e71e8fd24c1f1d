"""Vectorised text primitives used inside Arrow tasks.

A slice of an Arrow string column is one byte array plus document offsets; words, hashes and
windows are computed over the whole slice at once, so Python touches no single word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes handled at once; a longer single document is handled alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(31))  # the caller's stay as they are
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a, b of hashes."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


#: Longer byte ranges are hashed one by one.
LONG = 512


class RangeHash:
    """Hashes of byte ranges of one slice, eight bytes at a time.

    Who knows the multiplier and the start can solve for two ranges with one hash. They are constants unless a secret of
    two 64-bit numbers is given; where equal hashes decide about texts that others wrote, give one, or compare bytes."""

    def __init__(self, data: np.ndarray, secret: tuple[int, int] | None = None) -> None:
        self._secret = secret
        self._by, self._start = (np.uint64(secret[0] | 1), np.uint64(secret[1])) if secret else (np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        self._data = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        # the eight bytes from every place on
        self._at = np.ndarray((len(data) + 9,), dtype="<u8", buffer=self._data, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ self._start)
        live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
        while len(live):
            rest = size[live] - at
            chunk = self._at[start[live] + at]
            short = np.flatnonzero(rest < 8)
            chunk[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
            out[live] = mix(out[live] * self._by ^ chunk)
            live, at = live[rest > 8], at + 8
        for i in np.flatnonzero(size > LONG):
            long = self._data[start[i] : end[i]]
            out[i] = int.from_bytes(hashlib.blake2b(long, digest_size=8, key=self._secret[1].to_bytes(8, "little")).digest(), "little") if self._secret else xxhash.xxh3_64_intdigest(long)
        return out

    def fixed(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` bytes, a multiple of 8, by start."""
        n = len(self._data) - 16 - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.full(n, size, dtype=np.uint64)
        for at in range(0, size, 8):
            out = mix(out * self._by ^ self._at[at : at + n])
        return out


class TextSlice:
    """Bytes of some consecutive documents, with the offsets at which they start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets.astype(np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each maximal run of bytes other than ASCII white space."""
        n = len(self.data)
        if not n:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        inside = ~_SPACE[self.data]
        first = np.zeros(n + 1, dtype=bool)
        first[self.offsets] = True  # a document's words never join the next document's
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1


def column_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, TextSlice]]:
    """Cut an Arrow string column at document ends into slices of about ``limit`` bytes; null counts as empty.

    Yields the first row of each slice with the slice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, TextSlice(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def gram_hashes(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first-word index of every run of k words of one document."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(docs[:n] == docs[k - 1 :])
    return run_hashes(words, k)[at], at


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, joined from runs whose lengths are powers of two."""
    n = len(words) - k + 1
    out, done, power, size = None, 0, words, 1
    while True:
        if k & size:
            out = power[:n] if out is None else combine(out, power[done : done + n])
            done += size
        if 2 * size > k:
            return out if out is not words else words[:n]
        power, size = combine(power[: len(power) - size], power[size:]), 2 * size


def doc_bounds(docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each document's entries start in an array sorted by document, with the end appended."""
    return np.searchsorted(docs, np.arange(n_docs + 1))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row index of each list entry and the entries of a column of lists."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def word_codes(piece: TextSlice) -> tuple[np.ndarray, int]:
    """A number below the second value for each word of a slice, the same for the same bytes and for no others."""
    start, end, _ = piece.words()
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    inside = piece.data[~_SPACE[piece.data]]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(inside)]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))


def shingle_sets(piece: TextSlice, k: int, secret: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document, concatenated, and their bounds.

    A text of 1 to k-1 words has its whole word sequence as its only shingle; one without words has none."""
    start, end, docs = piece.words()
    hashes = RangeHash(piece.data, secret).of(start, end)
    grams, at = gram_hashes(hashes, docs, k)
    of = docs[at] if len(at) else at
    bounds, wb = doc_bounds(of, piece.n_docs), doc_bounds(docs, piece.n_docs)
    out, lens = [], np.zeros(piece.n_docs + 1, dtype=np.int64)
    for d in range(piece.n_docs):
        own = grams[bounds[d] : bounds[d + 1]]
        if not len(own) and wb[d + 1] > wb[d]:
            own = run_hashes(hashes[wb[d] : wb[d + 1]], int(wb[d + 1] - wb[d]))
        own = np.unique(own)
        out.append(own)
        lens[d + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.cumsum(lens)
