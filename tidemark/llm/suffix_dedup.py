"""Exact removal of long repeated byte strings by a prefix-free parse of the corpus.

A rolling hash picks triggers: the trigger of a window (a string of ``length`` bytes) is the least
16-byte gram of its first ``length`` - 56 bytes or so, which depends on the window's bytes alone. The
consecutive windows of a text that have one trigger make a phrase, and the text's parse is its
sequence of phrases. Equal windows have equal triggers at equal distance, so they lie in phrases that
share the bytes after the trigger (the phrase's tail). The dictionary is grouped by tail and phrase:

* a phrase whose tail is unique in the corpus holds no repeated window,
* a phrase found twice or more is repeated with all its windows, whatever their number,
* only tails shared by different phrases need the dictionary's suffixes: each of those distinct phrases
  is copied once into the dictionary, whose suffixes are first sifted by tiers of TIER windows: a tier whose
  common bytes are unique holds nothing, one all of whose bytes are found twice is repeated whole. The
  suffixes that begin in the rest are put in order, by their first ``length`` bytes, over range partitions with
  sampled bounds; there equal windows are neighbours, which are compared byte by byte.

Copies thus cost one row for each phrase, and only the ends of repeats are sorted. A suffix array of the whole
parse isn't built: which windows are equal is all that removal asks for, and phrases that are equal whole show it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_table, written
from .textops import RangeHash, TextSlice, column_slices, flat_lists, mix, signed

GRAM = 16
TAIL = 57
TIER = 16
#: Bytes of text for which the arrays of one step are made.
PIECE = 1 << 18


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive entries, in linear time."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def phrases(piece: TextSlice, length: int) -> tuple[np.ndarray, ...]:
    """Document, first and last window start and trigger (within the slice), tail hash and phrase hash of each phrase."""
    none = np.zeros(0, dtype=np.int64)
    span = length - TAIL + 1
    if len(piece.data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashed = RangeHash(piece.data)
    grams = hashed.fixed(GRAM)
    bits = np.uint64(max(22, len(grams).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    inner = piece.offsets[1:-1]
    crossing = (inner[:, None] - np.arange(1, GRAM)[None, :]).reshape(-1)
    key[crossing[(crossing >= 0) & (crossing < len(key))]] = np.iinfo(np.uint64).max
    trigger = (sliding_min(key, span) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    del key, grams
    starts, ends = piece.offsets[:-1], piece.offsets[1:] - length
    has = ends >= starts
    change = np.zeros(len(trigger) + 1, dtype=np.int32)
    np.add.at(change, starts[has], 1)
    np.add.at(change, ends[has] + 1, -1)
    windows = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(windows):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    own = trigger[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    first, last = windows[at], windows[np.append(at[1:], len(windows)) - 1]
    docs = np.searchsorted(piece.offsets, first, side="right") - 1
    tail = hashed.of(own[at], own[at] + TAIL)
    return docs, first, last, own[at], tail, hashed.of(first, last + length)


def _overlapping(column: pa.Array, length: int) -> Iterator[tuple[int, int, TextSlice]]:
    """Slices of a string column, of which each window is in one; a long text comes in pieces, with the place where each begins.

    A phrase that a piece cuts is two phrases, whose windows meet others' through the dictionary."""
    for row, piece in column_slices(column, PIECE):
        n = len(piece.data)
        if n <= 2 * PIECE:
            yield row, 0, piece
        else:
            for at in range(0, n - length + 1, PIECE):
                own = piece.data[at : at + PIECE + length - 1]
                yield row, at, TextSlice(own, np.array([0, len(own)]))


def _parse(length: int):
    """Phrases as (row, first, shape, tail, phrase); shape packs the last window and the trigger, both from first on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, at, piece in _overlapping(batch.column(1), length):
                docs, first, last, trigger, tail, phrase = phrases(piece, length)
                shape = (last - first) * 65536 + (trigger - first)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row + docs]), pa.array((first - piece.offsets[docs] + at).astype(np.int32)), pa.array(shape.astype(np.int32)), pa.array(signed(tail)), pa.array(signed(phrase))], names=["row", "first", "shape", "tail", "phrase"])

    return run


def _bodies(length: int):
    """The dictionary: bytes of the phrases asked for of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.schema.get_field_index
            at, entries = flat_lists(batch.column(index("opened")))
            first, shape = (entries.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("first", "shape"))
            for row, piece in column_slices(batch.column(index("text")), PIECE):
                mine = np.flatnonzero((at >= row) & (at < row + piece.n_docs))
                begin = piece.offsets[at[mine] - row] + first[mine]
                stop = begin + (shape[mine] >> 16) + length
                bodies = pa.array([piece.data[x:y].tobytes() for x, y in zip(begin, stop, strict=True)], pa.binary())
                picked = entries.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([batch.column(index("row")).take(pa.array(at[mine]))] + [picked.field(n) for n in ("first", "shape", "tail", "single")] + [bodies], names=["row", "first", "shape", "tail", "single", "body"])

    return run


def _tier_rows(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each tier of each phrase: the phrase's index, the tier, and its least and largest distance from the trigger."""
    near, far = (shape & 65535) - (shape >> 16), shape & 65535
    low, high = near // TIER, far // TIER
    n = high - low + 1
    of = np.repeat(np.arange(len(shape)), n)
    tier = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return of, tier, np.maximum(tier * TIER, near[of]), np.minimum(tier * TIER + TIER - 1, far[of])


def _tiers(length: int):
    """Tiers of dictionary phrases: common (hash of the bytes all its windows share) and whole (of all its bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.schema.get_field_index
            shape, tail = (batch.column(index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("shape", "tail"))
            for row, piece in column_slices(batch.column(index("body")), PIECE):
                own = slice(row, row + piece.n_docs)
                of, tier, low, high = _tier_rows(shape[own])
                hashed = RangeHash(piece.data)
                trigger = (piece.offsets[:-1] + (shape[own] & 65535))[of]
                seed = tail[own][of].view(np.uint64) * np.uint64(31) + tier.astype(np.uint64)
                common = mix(hashed.of(trigger - tier * TIER, trigger - tier * TIER - TIER + 1 + length) * np.uint64(5) + seed)
                whole = mix(hashed.of(trigger - high, trigger - low + length) * np.uint64(7) + seed * np.uint64(961) + (low * 1024 + high).astype(np.uint64))
                take = pa.array(row + of)
                yield pa.RecordBatch.from_arrays([pa.array(signed(common)), pa.array(signed(whole))] + [batch.column(index(n)).take(take) for n in ("row", "first", "shape", "single")] + [pa.array(tier.astype(np.int32))], names=["common", "whole", "row", "first", "shape", "single", "tier"])

    return run


def _open(length: int):
    """The first bytes of the suffixes that begin in the tiers asked for of each dictionary phrase, as (suffix, row, start, single)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.schema.get_field_index
            get = lambda n: batch.column(index(n)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            shape, begin, rows, single = get("shape").astype(np.int64), get("first"), get("row"), get("single")
            at, tiers = flat_lists(batch.column(index("tiers")))
            tiers = tiers.to_numpy(zero_copy_only=False)
            for row, piece in column_slices(batch.column(index("body")), PIECE // 16):
                mine = np.flatnonzero((at >= row) & (at < row + piece.n_docs))
                of, tier = at[mine], tiers[mine].astype(np.int64)
                near, far = (shape[of] & 65535) - (shape[of] >> 16), shape[of] & 65535
                low, high = np.maximum(tier * TIER, near), np.minimum(tier * TIER + TIER - 1, far)
                n = high - low + 1
                distance = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(of, n)
                start = (shape[of] & 65535) - distance
                if not len(of):
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(piece.data, length)[piece.offsets[of - row] + start]
                suffixes = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.arange(len(of) + 1, dtype=np.int32) * length), pa.py_buffer(np.ascontiguousarray(windows))])
                yield pa.RecordBatch.from_arrays([suffixes, pa.array(rows[of]), pa.array((begin[of] + start).astype(np.int32)), pa.array(single[of])], names=["suffix", "row", "start", "single"])

    return run


def _neighbours(length: int):
    """Sorted suffixes with repeated: whether one beside it in the partition has the same bytes. The partition's first and last keep theirs in edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, equal, is_first = None, False, True

        def rows(table: pa.RecordBatch, repeated: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
            kept = np.flatnonzero(edges | (repeated & table.column(2).to_numpy(zero_copy_only=False)))
            edge = pc.if_else(pa.array(edges[kept]), table.column(3).take(pa.array(kept)), pa.scalar(None, pa.binary()))
            return pa.RecordBatch.from_arrays([table.column(i).take(pa.array(kept)) for i in range(3)] + [pa.array(repeated[kept]), edge], names=["row", "start", "single", "repeated", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            column = table.column(3)
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, dtype=np.int32)[column.offset]
            windows = np.frombuffer(data, dtype=np.uint8)[at : at + len(column) * length].reshape(-1, length)
            same = (windows[1:] == windows[:-1]).all(axis=1)
            repeated = np.concatenate([[equal], same]) | np.append(same, False)
            edges = np.zeros(len(repeated), dtype=bool)
            edges[0] = is_first
            n = table.num_rows - 1
            if n:
                yield rows(table.slice(0, n), repeated[:n], edges[:n])
                is_first, equal = False, bool(same[-1])
            held = table.slice(n)
        if held is not None:
            yield rows(held, np.array([equal]), np.array([True]))

    return run


def kept_bytes(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Removed and kept byte ranges of a text whose windows starting at first..last are repeated."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > end[:-1]
    at = np.flatnonzero(new)
    removed = list(zip(first[at].tolist(), end[np.append(at[1:], len(first)) - 1].tolist(), strict=True))
    kept, here = [], 0
    for lo, hi in removed:
        kept.append((here, lo))
        here = hi
    return removed, [*kept, (here, len(text))]


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.schema.get_field_index
            at, entries = flat_lists(batch.column(index("repeats")))
            first, last = (entries.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("first", "last"))
            bounds = np.searchsorted(at, np.arange(batch.num_rows + 1))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                text = (batch.column(index("text"))[i].as_py() or "").encode()
                lo, hi = bounds[i], bounds[i + 1]
                if lo == hi:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                removed, kept = kept_bytes(text, first[lo:hi], last[lo:hi], length)
                digest = hashlib.sha256()
                for a, b in kept:
                    digest.update(text[a:b])
                out.append((len(text), sum(b - a for a, b in removed), len(removed), digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(index("doc_id"))] + [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(row, repeats): every window of length bytes that also starts elsewhere, as ranges (first, last) of starts.

    docs has row (naming the row's doc_id and text), doc_id and text."""
    spark = docs.sparkSession
    parse, parse_path = written(docs.select("row", "text").mapInArrow(_parse(length), "row long, first int, shape int, tail long, phrase long"))
    tails = parse.groupBy("tail").agg(F.count("*").alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high")).where("n > 1")
    # written, so that both sides of the join are plain shuffles, of which AQE may split a hot tail's
    tails, tails_path = written(tails.select("tail", (F.col("low") != F.col("high")).alias("mixed")))
    shared, shared_path = written(parse.join(tails, "tail"))
    drop_table(spark, parse_path)
    drop_table(spark, tails_path)
    last = (F.col("first") + F.shiftright("shape", 16)).alias("last")
    whole = shared.where("not mixed").select("row", "first", last)
    mixed = shared.where("mixed")
    phrases_, phrases_path = written(mixed.groupBy("tail", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "shape")).alias("at")))
    copied = mixed.join(phrases_.where("n > 1").select("tail", "phrase"), ["tail", "phrase"], "left_semi").select("row", "first", last)
    opened = phrases_.select("at.row", F.struct("at.first", "at.shape", "tail", (F.col("n") == 1).alias("single")).alias("entry")).groupBy("row").agg(F.collect_list("entry").alias("opened"))
    texts = docs.select("row", "text").join(opened, "row")
    dictionary, dictionary_path = written(texts.mapInArrow(_bodies(length), "row long, first int, shape int, tail long, single boolean, body binary"))
    tiers, tiers_path = written(dictionary.mapInArrow(_tiers(length), "common long, whole long, row long, first int, shape int, single boolean, tier int"))
    met = tiers.groupBy("common").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1")
    met, met_path = written(met.select("common", (F.col("low") != F.col("high")).alias("mixed")))
    close, close_path = written(tiers.join(met, "common").drop("common", "whole"))
    # a tier's windows start at trigger - distance; near and far are the phrase's own least and largest distance
    trigger, near = F.col("shape").bitwiseAND(65535), F.col("shape").bitwiseAND(65535) - F.shiftright("shape", 16)
    nearest, farthest = F.greatest(F.col("tier") * TIER, near), F.least(F.col("tier") * TIER + TIER - 1, trigger)
    tiered = close.where("single and not mixed").select("row", (F.col("first") + trigger - farthest).alias("first"), (F.col("first") + trigger - nearest).alias("last"))
    asked = close.where("mixed").groupBy("row", "first").agg(F.collect_set("tier").alias("tiers"))
    suffixes = dictionary.join(asked, ["row", "first"]).mapInArrow(_open(length), "suffix binary, row long, start int, single boolean")
    # by row and start as well, so that equal suffixes, however many, may lie in several partitions
    ordered = suffixes.repartitionByRange("suffix", "row", "start").sortWithinPartitions("suffix").select("row", "start", "single", "suffix")
    found, found_path = written(ordered.mapInArrow(_neighbours(length), "row long, start int, single boolean, repeated boolean, edge binary"))
    # where one partition ends and the next begins: two rows a partition
    across = found.where("edge is not null").groupBy("edge").agg(F.count("*").alias("n")).where("n > 1").select("edge")
    at_edges = found.where("single and not repeated and edge is not null").join(across, "edge", "left_semi")
    ends = found.where("single and repeated").unionByName(at_edges).select("row", F.col("start").alias("first"), F.col("start").alias("last"))
    spans = whole.unionByName(copied).unionByName(tiered).unionByName(ends).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("repeats"))
    spans, _ = written(spans)
    for path in (shared_path, phrases_path, dictionary_path, tiers_path, met_path, close_path, found_path):
        drop_table(spark, path)
    return spans


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """What stays of each document without the bytes that strings repeated in the corpus cover.

    A byte goes if a string of length bytes that covers it also starts anywhere else, in the same document
    or another; overlaps count, matches never cross documents, and strings are judged on the input. Takes
    doc_id and text; returns one row per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs)
    and kept_sha256 (of the bytes that stay, joined).

    Defined cases: a null text is empty; texts shorter than length bytes stay whole; rows that repeat a
    doc_id are documents of their own, and so remove each other if their texts are long and equal."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    spans = repeated_windows(docs, length)
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.join(spans, "row", "left").select("row", "doc_id", "text", "repeats")
    return joined.mapInArrow(_digest(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
