"""Fuzzy passages shared by documents: seeds, collinear chains, alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .staging import drop_table, written
from .suffix_dedup import sliding_min
from .textops import RangeHash, column_slices, doc_bounds, flat_lists, gram_hashes, mix, run_hashes, signed

#: Consecutive k-word seeds of which at least one is kept.
WINDOW = 16
GAP_COST = 0.25
#: The other document's words are fetched in blocks of so many, so that its passages' requests coincide.
BLOCK = 64
PIECE = 1 << 20
#: Pairs of passages that are aligned at once.
PAIRS = 256
#: Words before and after a seed of which one bit each goes with it, and those of them that show a shift.
CONTEXT, SHIFTED = 48, 12
#: Words from a seed on, and up to it, whose first carriers are looked for besides the seed's own.
SCALES = (14, 28)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of the CONTEXT words from every word on, the nearest lowest."""
    out = np.zeros(len(hashes) + CONTEXT, dtype=np.uint64)
    out[: len(hashes)] = (hashes >> np.uint64(29)) & np.uint64(1)
    for width in (1, 2, 4, 8):
        out[:-width] |= out[width:] << np.uint64(width)
    n = len(hashes)
    return out[:n] | out[16 : n + 16] << np.uint64(16) | out[32 : n + 32] << np.uint64(32)


def _contexts(hashes: np.ndarray, at: np.ndarray, k: int, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the words before and after the seeds at words at, and how many words their texts have there."""
    padded = np.concatenate([hashes, hashes[:1]])
    before, after = _bits(padded[::-1])[::-1], _bits(padded)
    size = np.uint64(CONTEXT)
    n_before, n_after = (np.minimum(x, CONTEXT).astype(np.uint64) << size for x in (at - begin, stop - at - k))
    low = (np.uint64(1) << size) - np.uint64(1)
    return (before[at - 1] & low) | n_before, (after[at + k] & low) | n_after


def _reach(a: np.ndarray, b: np.ndarray, drop: int = 6) -> np.ndarray:
    """How far the words beside two seeds may stay alike by the bits of their contexts; CONTEXT where the bits don't end it.

    Along the seeds' diagonal: +1 for equal bits, -2 for unlike ones, up to the best score before it falls by
    more than drop. Where SHIFTED bits go on alike behind the first unlike word, put off by up to three words
    on either side, words were put in, left out or replaced there, and the end is open."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    n = np.minimum(a >> np.uint64(CONTEXT), b >> np.uint64(CONTEXT)).astype(np.int64)
    first = (a ^ b) | (np.uint64(1) << n.astype(np.uint64))
    first &= ~first + np.uint64(1)
    run = np.frexp(first.astype(np.float64))[1].astype(np.int64) - 1
    at = run.copy()  # all that there is, where no word is unlike
    some = np.flatnonzero(run < n)
    at[some] = _scored_reach(a[some] ^ b[some], n[some], drop)
    open_ = np.flatnonzero((run + 1 + SHIFTED <= n) & (at < CONTEXT))
    a, b, n, run = a[open_], b[open_], n[open_], run[open_].astype(np.uint64)
    low = np.uint64((1 << SHIFTED) - 1)
    later = [[x >> (run + np.uint64(i)) for i in range(4)] for x in (a, b)]
    for i in range(4):
        for j in range(4):
            if i or j:
                alike = (later[0][i] ^ later[1][j]) & low == 0
                at[open_[alike & (run.astype(np.int64) + max(i, j) + SHIFTED <= n)]] = CONTEXT
    return at


def _scored_reach(unlike: np.ndarray, n: np.ndarray, drop: int) -> np.ndarray:
    """The place of the best score along each row's n bits, +1 for 0 and -2 for 1, before it falls by more than drop; CONTEXT if it doesn't."""
    bits = np.unpackbits(np.ascontiguousarray(unlike, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, count=CONTEXT, bitorder="little").T
    steps = 1 - 3 * np.ascontiguousarray(bits).astype(np.int8)
    n = n.astype(np.int8)
    score, best, at = (np.zeros(len(unlike), dtype=np.int8) for _ in range(3))
    live = np.ones(len(unlike), dtype=bool)
    for i in range(CONTEXT):
        live &= (n > i) & (score >= best - np.int8(drop))
        if not live.any():
            break
        score += steps[i] * live
        better = live & (score > best)
        best[better], at[better] = score[better], i + 1
    at[live & (score >= best - np.int8(drop))] = CONTEXT
    return at


def _reached(min_words: int, k: int):
    """Matches with what their contexts allow on the left and on the right in place of both contexts.

    scale 0 marks windows of min_words equal words, which reach as far by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            left, right = (_reach(get(n).to_numpy(), get(f"other_{n}").to_numpy()) for n in ("before", "after"))
            whole = get("scale").to_numpy() == 0
            left[whole], right[whole] = 0, min_words - k
            names = [n for n in batch.schema.names if n not in ("before", "after", "other_before", "other_after", "scale")]
            yield pa.RecordBatch.from_arrays([get(n) for n in names] + [pa.array(x.astype(np.int32)) for x in (left, right)], names=[*names, "left", "right"])

    return run


def _least(grams: np.ndarray) -> np.ndarray:
    """The place of the least of every WINDOW consecutive hashes."""
    bits = np.uint64(max(22, len(grams).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(key, WINDOW) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _seeds(k: int):
    """Seeds (hash, row, word, contexts) of each text: the least of every WINDOW consecutive k-word hashes.

    A seed that a text repeats is given once more with its number among its repeats, so that texts of
    repeated lines match line by line and not all to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1)
            for row, piece in column_slices(batch.column(2), PIECE):
                start, end, docs = piece.words()
                hashes = RangeHash(piece.data).of(start, end)
                grams, at = gram_hashes(hashes, docs, k)
                if len(grams) < WINDOW:
                    continue
                of = docs[at]
                low = _least(grams)
                whole = of[: len(low)] == of[WINDOW - 1 :]  # windows of one document
                chosen = low[whole]  # in order, as windows are
                chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])[: len(chosen)]]
                bounds = doc_bounds(docs, piece.n_docs)
                first, stop = bounds[of[chosen]], bounds[of[chosen] + 1]
                contexts = _contexts(hashes, at[chosen], k, first, stop)
                seeds, again = grams[chosen], _repeats(grams[chosen], of[chosen])
                later = np.flatnonzero(again)
                seeds = np.concatenate([seeds, mix(seeds[later] + again[later] * np.uint64(0xA0761D6478BD642F))])
                mine = row + np.concatenate([of[chosen], of[chosen][later]])
                word = at[chosen] - first
                word = np.concatenate([word, word[later]])
                before, after = (pa.array(signed(np.concatenate([x, x[later]]))) for x in contexts)
                yield pa.RecordBatch.from_arrays([pa.array(signed(seeds)), pa.array(rows[mine]), ids.take(pa.array(mine)), pa.array(word.astype(np.int32)), before, after], names=["seed", "row", "doc_id", "word", "before", "after"])

    return run


def _windows(k: int, min_words: int):
    """Longer keys of each text at the seeds listed for it, as (seed, row, doc_id, word, contexts, scale).

    For open seeds, the SCALES words that begin or end with the seed; and all windows of min_words words of which every
    seed is listed (scale 0), by their first word."""
    n_low = min_words - k + 1 - (WINDOW - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            of_row, lists = flat_lists(get("words"))
            words, is_open = (lists.field(n).to_numpy(zero_copy_only=False) for n in ("word", "open"))
            for row, piece in column_slices(get("text"), PIECE):
                start, end, docs = piece.words()
                hashes = RangeHash(piece.data).of(start, end)
                grams, at = gram_hashes(hashes, docs, k)
                if not len(grams):
                    continue
                mine = (of_row >= row) & (of_row < row + piece.n_docs)
                bounds = doc_bounds(docs, piece.n_docs)
                placed = bounds[of_row[mine] - row] + words[mine]
                keys, anchor, scale = [], [], []
                own, of = placed[is_open[mine]], of_row[mine][is_open[mine]] - row
                begin, stop = bounds[of], bounds[of + 1]
                for n in SCALES:
                    runs = run_hashes(hashes, n) if len(hashes) >= n else hashes[:0]
                    for back in (0, n - k):  # the seed begins the run, or ends it
                        hit = own[(own - back >= begin) & (own - back + n <= stop)]
                        keys.append(mix(runs[hit - back] + np.uint64(2 * n + bool(back))))
                        anchor.append(hit)
                        scale.append(np.full(len(hit), n))
                whole, first = gram_hashes(hashes, docs, min_words)
                if len(whole):
                    listed = np.zeros(len(hashes), dtype=bool)
                    listed[placed] = True
                    held = np.concatenate([[0], np.cumsum(listed[at[_least(grams)]])])
                    place = np.searchsorted(at, first)
                    kept = np.flatnonzero(held[place + n_low] - held[place] == n_low)
                    keys.append(whole[kept])
                    anchor.append(first[kept])
                    scale.append(np.zeros(len(kept), dtype=np.int64))
                anchor = np.concatenate(anchor)
                of = docs[anchor]
                contexts = _contexts(hashes, anchor, k, bounds[of], bounds[of + 1])
                rows = pa.array(row + of)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), get("row").take(rows), get("doc_id").take(rows), pa.array((anchor - bounds[of]).astype(np.int32)), *(pa.array(signed(x)) for x in contexts), pa.array(np.concatenate(scale).astype(np.int32))], names=["seed", "row", "doc_id", "word", "before", "after", "scale"])

    return run


def _repeats(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """How often each entry's hash stands before it in its document; entries are in order of place."""
    order = np.lexsort((hashes, docs))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    place = np.arange(len(order))
    out = np.zeros(len(order), dtype=np.uint64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


class Fenwick:
    """Prefix maxima with their owners."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The largest value at places 0 to i."""
        out = (-np.inf, -1)
        i += 1
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def anchors(word: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Seed matches joined along their diagonals: rows of start, end and the other document's start, in order."""
    order = np.lexsort((word, word - other))
    word, other = word[order], other[order]
    new = np.ones(len(word), dtype=bool)
    new[1:] = ((word - other)[1:] != (word - other)[:-1]) | (word[1:] - word[:-1] > WINDOW + k)
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(word)) - 1
    out = np.stack([word[at], word[stop] + k, other[at]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def chains(found: np.ndarray) -> list[list[int]]:
    """Disjoint collinear chains of anchors, best first: lengths less GAP_COST for each word skipped on either side."""
    n = len(found)
    if n < 2:
        return [[0]] * n
    start, end, other = found[:, 0], found[:, 1], found[:, 2]
    other_end = other + end - start
    places = np.unique(other_end)
    rank = np.searchsorted(places, other_end).tolist()
    reach = (np.searchsorted(places, other, side="right") - 1).tolist()
    tree, score, before = Fenwick(len(places)), (end - start).astype(float).tolist(), [-1] * n
    by_end, done = np.argsort(end, kind="stable").tolist(), 0
    put, take = (GAP_COST * (end + other_end)).tolist(), (GAP_COST * (start + other)).tolist()
    start, end = start.tolist(), end.tolist()
    for i in range(n):
        while done < n and end[by_end[done]] <= start[i]:
            j = by_end[done]
            tree.put(rank[j], (score[j] + put[j], j))
            done += 1
        if done and reach[i] >= 0:
            best, j = tree.upto(reach[i])
            gain = best - take[i]
            if j >= 0 and gain > 0:
                score[i] += gain
                before[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        own, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(j)
            j = before[j]
        if own:
            out.append(own[::-1])
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole runs of rows with equal keys, from batches in which they stand together, with where each run begins."""
    kept: list[pa.RecordBatch] = []

    def begins(table: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for n in keys:
            column = table.column(table.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([*kept, batch]).combine_chunks().to_batches()[0] if kept else batch
            first = begins(table)
            kept = [table.slice(first[-1])]  # it may go on
            if len(first) > 1:
                yield table.slice(0, first[-1]), first[:-1]
    for table in kept:
        yield table, begins(table)


def _ends(found: np.ndarray, word: np.ndarray, other: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """The words from and to which each anchor extends at most, by the contexts of its outermost seeds."""
    reach = {(w, o): (x, y) for w, o, x, y in zip(word.tolist(), other.tolist(), left.tolist(), right.tolist(), strict=True)}
    low = [start - reach[start, at][0] for start, _, at in found.tolist()]
    high = [end + reach[end - k, at + end - k - start][1] for start, end, at in found.tolist()]
    return low, high


def _chained(k: int, min_words: int):
    """Anchors of the chains of each (row, other) group that may belong to a passage of min_words words, by region.

    A chain is left out only where the contexts of its seeds show that no part of it extends so far. Groups on one
    diagonal without wide gaps, which most are, are one anchor each and need no chaining."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_groups(batches, ["row", "other"]):
            word, other, left, right = (table.column(table.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("word", "other_word", "left", "right"))
            last = np.append(first[1:], table.num_rows) - 1
            wide = np.maximum.reduceat(word + right, first) + k - np.minimum.reduceat(word - left, first) >= min_words
            step = np.zeros(len(word), dtype=np.int64)
            step[1:] = word[1:] - word[:-1]
            step[first] = 0
            diagonal = word - other
            plain = (np.maximum.reduceat(diagonal, first) == np.minimum.reduceat(diagonal, first)) & (np.maximum.reduceat(step, first) <= WINDOW + k)
            easy = np.flatnonzero(wide & plain & (word[last] + right[last] + k - word[first] + left[first] >= min_words))
            at, stop = first[easy], last[easy]
            of = [at]
            found = [np.stack([word[at], word[stop] + k, other[at]], axis=1)]
            sizes = [np.ones(len(easy), dtype=np.int64)]
            for i in np.flatnonzero(wide & ~plain):
                own = slice(first[i], last[i] + 1)
                joined = anchors(word[own], other[own], k)
                low, high = _ends(joined, word[own], other[own], left[own], right[own], k)
                kept = [joined[c] for c in chains(joined) if max(high[j] for j in c) - min(low[j] for j in c) >= min_words]
                for region in regions(kept):
                    of.append(first[i : i + 1])
                    found.append(region)
                    sizes.append(np.array([len(region)]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(3 * np.concatenate(sizes))]).astype(np.int32)), pa.array(np.concatenate(found).reshape(-1).astype(np.int32)))
            take = pa.array(np.concatenate(of))
            names = ["row", "other", "doc_id", "other_id"]
            yield pa.RecordBatch.from_arrays([table.column(table.schema.get_field_index(n)).take(take) for n in names] + [lists], names=[*names, "anchors"])

    return run


def regions(found: list[np.ndarray], near: int = 64) -> list[np.ndarray]:
    """Anchors of chains that lie near each other in both documents, together, each set in order of place."""
    boxes: list[list] = []
    for rows, own in sorted(((c.tolist(), c) for c in found), key=lambda c: (c[0][0][0], c[0][0][2])):
        box = [rows[0][0], max(r[1] for r in rows), min(r[2] for r in rows), max(r[2] + r[1] - r[0] for r in rows), [own]]
        if boxes:
            last = boxes[-1]
            if box[0] <= last[1] + near and box[2] <= last[3] + near and last[2] <= box[3] + near:
                boxes[-1] = [last[0], max(last[1], box[1]), min(last[2], box[2]), max(last[3], box[3]), [*last[4], own]]
                continue
        boxes.append(box)
    joined = [np.concatenate(b[4]) for b in boxes]
    return [x[np.lexsort((x[:, 2], x[:, 0]))] for x in joined]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the ranges asked for of each text, cut to the text."""
    for batch in batches:
        index = batch.schema.get_field_index
        asked = batch.column(index("ranges"))
        at = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
        ranges = asked.flatten()
        low, high = (ranges.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("low", "high"))
        rows = batch.column(index("row")).to_numpy(zero_copy_only=False)
        for first, piece in column_slices(batch.column(index("text")), PIECE):
            start, end, docs = piece.words()
            # half of each hash: runs of k words, which decide, keep k times as many bits
            hashes = (RangeHash(piece.data).of(start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            bounds = doc_bounds(docs, piece.n_docs)
            mine = np.flatnonzero((at >= first) & (at < first + piece.n_docs))
            begin, stop = bounds[at[mine] - first], bounds[at[mine] - first + 1]
            a, b = np.minimum(begin + low[mine], stop), np.minimum(begin + high[mine], stop)
            lists = [hashes[x:y] for x, y in zip(a, b, strict=True)]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else hashes[:0]
            yield pa.RecordBatch.from_arrays([pa.array(rows[at[mine]]), pa.array(low[mine].astype(np.int32)), pa.array(high[mine].astype(np.int32)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["of", "low", "high", "words"])


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, each with its number among its like mixed in, sorted, and their places."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    place = np.arange(len(order))
    new = np.append(True, sorted_[1:] != sorted_[:-1])[: len(order)]
    if not new.all():
        sorted_ = sorted_ + (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        again = np.argsort(sorted_, kind="stable")
        return sorted_[again], order[again]
    return sorted_, order


class Pairs:
    """Word sequences a and b of several pairs of texts, laid end to end, with their k-word shingle hashes by first word."""

    def __init__(self, a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray, k: int) -> None:
        self.k, self.bounds = k, (a_bounds, b_bounds)
        self.of = [np.repeat(np.arange(len(x) - 1), np.diff(x)) for x in self.bounds]
        self.grams, self.at = [], []
        for words, of in zip((a, b), self.of, strict=True):
            grams, at = gram_hashes(words.astype(np.uint64), of, k)
            by_word = np.zeros(len(words), dtype=np.uint64)
            by_word[at] = grams
            self.grams.append(by_word)
            self.at.append(at)

    def equal_runs(self, found: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of k equal words or more: rows of start, end and the other's start within the texts, in order, and each run's pair.

        Every shingle meets the one with its number among its like; those on the diagonals of the anchors found
        (of the pairs given) meet as well."""
        k, (a_first, b_first) = self.k, self.bounds
        keys = [_numbered(mix(g[at] + (of[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))) for g, at, of in zip(self.grams, self.at, self.of, strict=True)]
        (left, i), (right, j) = keys
        place = np.minimum(np.searchsorted(right, left), max(len(right) - 1, 0))
        hit = right[place] == left if len(right) else np.zeros(len(left), dtype=bool)
        i, j = self.at[0][i[hit]], self.at[1][j[place[hit]]]
        sizes = found[:, 1] - found[:, 0] - k + 1
        more = np.repeat(a_first[pair] + found[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        other = more + np.repeat(b_first[pair] + found[:, 2] - a_first[pair] - found[:, 0], sizes)
        same = self.grams[0][more] == self.grams[1][other]
        i, j = np.concatenate([i, more[same]]), np.concatenate([j, other[same]])
        of = self.of[0][i]
        diagonal = (i - a_first[of]) - (j - b_first[of])
        order = np.lexsort((i, diagonal, of))
        i, diagonal, of = i[order], diagonal[order], of[order]
        moved = (of[1:] != of[:-1]) | (diagonal[1:] != diagonal[:-1])
        once = np.append(True, moved | (i[1:] != i[:-1]))[: len(i)]
        i, diagonal, of = i[once], diagonal[once], of[once]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1))[: len(i)])
        last = np.append(first[1:], len(i))[: len(first)] - 1
        start, end = i[first] - a_first[of[first]], i[last] - a_first[of[first]] + k
        runs, of = np.stack([start, end, start - diagonal[first]], axis=1), of[first]
        order = np.lexsort((runs[:, 2], runs[:, 0], of))
        return runs[order], of[order]

    def similarity(self, pair: int, start: int, end: int, other: int, other_end: int) -> float:
        """Jaccard similarity of two passages' shingles."""
        parts = ((self.grams[0], self.bounds[0][pair], start, end), (self.grams[1], self.bounds[1][pair], other, other_end))
        x, y = (np.sort(g[at + lo : at + hi - self.k + 1]) for g, at, lo, hi in parts)
        x, y = (z[np.append(True, z[1:] != z[:-1])] for z in (x, y))
        both = np.sort(np.concatenate([x, y]))
        both = int((both[1:] == both[:-1]).sum())
        return both / (len(x) + len(y) - both)

    def passages(self, pair: int, runs: np.ndarray, min_words: int, percent: int) -> list[tuple[int, int, int, int, float]]:
        """Passages (start, end, other start, other end, similarity) along the runs of a pair.

        The runs are chained; a part of a chain that is long enough on both sides but not alike enough is split at
        its widest gap, and both parts are judged on their own. Passages begin and end with equal words; chains
        inside a passage of a better one are passed over."""
        if len(runs) == 1:
            start, end, other = runs[0].tolist()
            return [(start, end, other, other + end - start, 1.0)] if end - start >= min_words else []
        out, k, places = [], self.k, runs.tolist()
        for chain in chains(runs):
            first, last = places[chain[0]], places[chain[-1]]
            if min(last[1] - first[0], last[2] + last[1] - last[0] - first[2]) < min_words:
                continue  # nor is any part long enough
            start, end, other = runs[chain].T
            if any(p[0] <= start[0] and end[-1] <= p[1] for p in out):
                continue
            other_end = other + end - start
            common = np.concatenate([[0], np.cumsum(end - start - k + 1)])
            gap = (start[1:] - end[:-1]) + (other[1:] - other_end[:-1])
            parts = [(0, len(chain))]
            while parts:
                x, y = parts.pop()
                place = int(start[x]), int(end[y - 1]), int(other[x]), int(other_end[y - 1])
                size, other_size = place[1] - place[0], place[3] - place[2]
                if min(size, other_size) < min_words:
                    continue
                both = common[y] - common[x]
                if 100 * both >= percent * (size + other_size - 2 * (k - 1) - both):
                    like = self.similarity(pair, *place)
                    if 100 * like >= percent:
                        out.append((*place, like))
                        continue
                if y - x > 1:
                    widest = np.flatnonzero(gap[x : y - 1] == gap[x : y - 1].max()) + x + 1
                    at = int(widest[np.argmin(np.abs(2 * widest - x - y))])
                    parts += [(at, y), (x, at)]
        return sorted(out)


def align(a: np.ndarray, b: np.ndarray, found: np.ndarray, k: int, min_words: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Passages of one pair of word sequences, near the anchors found."""
    pairs = Pairs(a, np.array([0, len(a)]), b, np.array([0, len(b)]), k)
    runs, _ = pairs.equal_runs(found, np.zeros(len(found), dtype=np.int64))
    return pairs.passages(0, runs, min_words, percent)


def _aligned(k: int, min_words: int, percent: int, ids: pa.DataType):
    types = [pa.int64(), ids, ids] + [pa.int64()] * 4 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
                laid = []
                for n in ("words", "other_words"):
                    laid += [get(n).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(get(n).value_lengths().to_numpy(zero_copy_only=False))])]
                pairs = Pairs(*laid, k)
                found = get("anchors").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3)
                pair = np.repeat(np.arange(batch.num_rows), get("anchors").value_lengths().to_numpy(zero_copy_only=False) // 3)
                low, other_low = (get(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("low", "other_low"))
                runs, of = pairs.equal_runs(found - np.stack([low, low, other_low], axis=1)[pair], pair)
                bounds = np.searchsorted(of, np.arange(batch.num_rows + 1))
                rows, doc, ref = get("row"), get("doc_id"), get("other_id")
                out = []
                for i in range(batch.num_rows):
                    for lo, hi, other_lo, other_hi, like in pairs.passages(i, runs[bounds[i] : bounds[i + 1]], min_words, percent):
                        out.append((rows[i].as_py(), doc[i].as_py(), ref[i].as_py(), lo + low[i], hi + low[i], other_lo + other_low[i], other_hi + other_low[i], like))
                columns = list(zip(*out, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "doc_id", "ref_doc_id", "start_word", "end_word", "ref_start_word", "ref_end_word", "similarity"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def shared_passages(docs: DataFrame, k: int = 5, min_words: int = 50, percent: int = 80, margin: int = 128) -> DataFrame:
    """Passages of min_words words or more that a document shares with an earlier one, k-word similarity percent/100 or more.

    docs has doc_id and text. Returns one row per passage and earlier document: row (a key of the
    document's doc_id and text), doc_id, start_word, end_word, ref_doc_id, ref_start_word, ref_end_word and
    similarity. Words are runs of characters other than ASCII white space; a passage begins and ends with k equal words.

    Each seed's occurrences are joined to its first one, by doc_id, and not to each other: the matches are
    as many as the seeds, however many documents share a passage. Every chain of matches is verified that
    may extend to min_words by the contexts of its seeds. A seed's first carrier may lack the passage; so the
    seeds outside the passages found are joined once more, to the first carriers of longer runs of words
    (SCALES) that begin and end with them, and of every window of min_words words of shared seeds, so that
    no exact passage is missed. margin bounds the words by which a chain is looked at beyond its outermost seeds.

    Defined cases: null, empty and short texts have no passages; a passage that repeats within one
    document only isn't reported; rows that repeat a doc_id and text count as one document; null doc_ids come first."""
    docs, spark = _keyed(docs), docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    verified = lambda matches: _verified(docs, matches, k, min_words, percent, margin)
    found = docs.select("row", "doc_id", "text").mapInArrow(_seeds(k), f"seed long, row long, doc_id {kind}, word int, before long, after long").withColumn("scale", F.lit(k))
    occurrences, path = written(found)
    matches, matches_path = written(_first_carriers(occurrences, min_words, k))
    drop_table(spark, path)
    passages = verified(matches.where("row <> other"))
    longer, longer_path = written(_longer_keys(docs, matches, passages, k, min_words))
    drop_table(spark, matches_path)
    size = F.when(F.col("scale") == 0, min_words).otherwise(k)
    later = _first_carriers(longer, min_words, k, lambda m: _outside(m.where("row <> other"), passages, 0, size).where("outside"))
    # what only lies inside a passage found before is no new one
    more = _outside(verified(later).withColumn("word", F.col("start_word")), passages, 0, F.col("end_word") - F.col("start_word")).where("outside").select(*passages.columns)
    drop_table(spark, longer_path)
    return passages.unionByName(more)


def _first_carriers(occurrences: DataFrame, min_words: int, k: int, only=lambda matches: matches) -> DataFrame:
    """Each occurrence of a seed that has more than one, with the first one (other) and how far both may be alike."""
    # written, so that both sides of the join are plain shuffles, of which AQE may split a hot seed's
    carriers, path = written(occurrences.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "word", "before", "after")).alias("first")).where("n > 1").select("seed", "first"))
    both = occurrences.join(carriers, "seed")
    both = only(both.select(*occurrences.columns, F.col("first.row").alias("other"), F.col("first.doc_id").alias("other_id"), F.col("first.word").alias("other_word"), F.col("first.before").alias("other_before"), F.col("first.after").alias("other_after")))
    ids = occurrences.schema["doc_id"].dataType.simpleString()
    fields = f"seed long, row long, doc_id {ids}, word int, other long, other_id {ids}, other_word int, left int, right int"
    both = both.select("seed", "row", "doc_id", "word", "other", "other_id", "other_word", "before", "after", "other_before", "other_after", "scale")
    return both.mapInArrow(_reached(min_words, k), fields)


def _outside(rows: DataFrame, passages: DataFrame, least: int, n: int | Column, plain: str | None = None) -> DataFrame:
    """rows (row, word, ...) with outside: no passage has n words from word on and least words more on both sides; plain names the same with none more."""
    covered = passages.groupBy("row").agg(F.collect_set(F.struct("start_word", "end_word")).alias("_ranges"))

    def outside(least: int) -> Column:
        return ~F.coalesce(F.exists("_ranges", lambda r: (F.col("word") - least >= r["start_word"]) & (F.col("word") + n + least <= r["end_word"])), F.lit(False))

    return rows.join(covered, "row", "left").withColumns({"outside": outside(least)} | ({plain: outside(0)} if plain else {})).drop("_ranges")


def _longer_keys(docs: DataFrame, matches: DataFrame, passages: DataFrame, k: int, min_words: int) -> DataFrame:
    """Longer keys at all occurrences of the seeds that have one which the passages found leave out.

    All seeds of a shared window of min_words words are shared, and in the later document stand so near a passage's
    end, if in one, that only seeds with an occurrence like that need be looked at; the shorter keys are for those
    with one outside any passage."""
    near = _outside(matches.where("row <> other").select("seed", "row", "word"), passages, min_words - k, k, "open").where("outside")
    # written, so that both sides of the join are plain shuffles, of which AQE may split a hot seed's
    seeds, _ = written(near.groupBy("seed").agg(F.max("open").alias("open")))
    asked = matches.select("seed", "row", "word").join(seeds, "seed").groupBy("row").agg(F.collect_set(F.struct("word", "open")).alias("words"))
    texts = docs.select("row", "doc_id", "text").join(asked, "row")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_windows(k, min_words), f"seed long, row long, doc_id {kind}, word int, before long, after long, scale int")


def _verified(docs: DataFrame, matches: DataFrame, k: int, min_words: int, percent: int, margin: int) -> DataFrame:
    """The passages along chains of matches; docs have row and text."""
    sorted_matches = matches.select("row", "doc_id", "word", "other", "other_id", "other_word", "left", "right").repartition("row").sortWithinPartitions("row", "other", "word", "other_word")
    kind = docs.schema["doc_id"].dataType
    ids, kind = to_arrow_type(kind), kind.simpleString()
    found, found_path = written(sorted_matches.mapInArrow(_chained(k, min_words), f"row long, other long, doc_id {kind}, other_id {kind}, anchors array<int>"))
    n = F.size("anchors")
    part = lambda i: F.transform(F.sequence(F.lit(i), n - 1, F.lit(3)), lambda j: F.get("anchors", j))
    begin, stop, other_begin = F.array_min(part(0)), F.array_max(part(1)), F.array_min(part(2))
    other_stop = F.array_max(F.transform(F.sequence(F.lit(0), n - 1, F.lit(3)), lambda j: F.get("anchors", j + 2) + F.get("anchors", j + 1) - F.get("anchors", j)))
    block = lambda x, up: ((F.floor(x / BLOCK) + up) * BLOCK).cast("int")
    found = found.where(n > 0).withColumns({"low": F.greatest(begin - margin, F.lit(0)), "high": stop + margin})
    found = found.withColumns({"other_low": block(F.greatest(other_begin - margin, F.lit(0)), 0), "other_high": block(other_stop + margin, 1)})
    asked = found.select("row", "low", "high").unionByName(found.select(F.col("other").alias("row"), F.col("other_low").alias("low"), F.col("other_high").alias("high"))).distinct()
    ranges = asked.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    texts = docs.select("row", "text").join(ranges, "row")
    words, words_path = written(texts.mapInArrow(_words, "of long, low int, high int, words array<int>").dropDuplicates(["of", "low", "high"]))
    own = words.select(F.col("of").alias("row"), "low", "high", "words")
    others = words.select(F.col("of").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"), F.col("words").alias("other_words"))
    pairs = found.join(own, ["row", "low", "high"]).join(others, ["other", "other_low", "other_high"])
    passage = f"row long, doc_id {kind}, ref_doc_id {kind}, start_word long, end_word long, ref_start_word long, ref_end_word long, similarity double"
    pairs = pairs.select("row", "doc_id", "other_id", "anchors", "low", "other_low", "words", "other_words")
    passages, _ = written(pairs.mapInArrow(_aligned(k, min_words, percent, ids), passage))
    drop_table(docs.sparkSession, found_path)
    drop_table(docs.sparkSession, words_path)
    return passages


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their ranges; the white space before a removed word goes with it."""
    for batch in batches:
        index = batch.schema.get_field_index
        texts, of = batch.column(index("text")), index("ranges")
        asked = batch.column(of)
        out: list[str | None] = []
        for first, piece in column_slices(texts, PIECE):
            start, end, docs = piece.words()
            bounds = doc_bounds(docs, piece.n_docs)
            for d in range(piece.n_docs):
                i = first + d
                cuts = asked[i].as_py()
                if not cuts:
                    out.append(texts[i].as_py())
                    continue
                gone = np.zeros(bounds[d + 1] - bounds[d] + 1, dtype=np.int64)
                for r in cuts:
                    gone[r["low"]] += 1
                    gone[r["high"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                lo, hi = piece.offsets[d], piece.offsets[d + 1]
                own_end = end[bounds[d] : bounds[d + 1]]
                # each word owns the bytes from the end of the word before it
                begin = np.concatenate([[lo], own_end[:-1]])
                parts, data = [], piece.data
                edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    parts.append(data[begin[a] : own_end[b - 1]].tobytes())
                if len(own_end) and not gone[-1]:
                    parts.append(data[own_end[-1] : hi].tobytes())
                out.append(b"".join(parts).decode())
        arrays = [pa.array(out, pa.string()) if n == "text" else batch.column(j) for j, n in enumerate(batch.schema.names) if n != "ranges"]
        yield pa.RecordBatch.from_arrays(arrays, names=[n for n in batch.schema.names if n != "ranges"])


def remove_shared_passages(docs: DataFrame, **options) -> DataFrame:
    """docs with every passage that an earlier document has taken out of text; documents and columns stay.

    A null text stays null."""
    spans = shared_passages(docs, **options).groupBy("row").agg(F.collect_set(F.struct(F.col("start_word").alias("low"), F.col("end_word").alias("high"))).alias("ranges"))
    joined = docs.select(F.struct("*").alias("_doc"), F.xxhash64("doc_id", "text").alias("row"), "text").join(spans, "row", "left")
    kind = docs.schema.simpleString()
    cleaned = joined.select("_doc", "text", "ranges").mapInArrow(_without, f"_doc {kind}, text string")
    return cleaned.select(*[F.col("text") if c == "text" else F.col(f"_doc.{c}") for c in docs.columns])
