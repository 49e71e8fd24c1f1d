"""Phrase collocations by contiguous pattern growth over projected occurrence pointers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .staging import cut, written
from .textops import TextSlice, column_slices, mix

#: Text bytes whose pointers are put together before they are shuffled.
SLICE_BYTES = 4 << 20

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(piece: TextSlice) -> Iterator[TextSlice]:
    """A slice as it is; a single text longer than a slice is cut behind breaks, where no phrase goes on."""
    while len(piece.data) > SLICE_BYTES and piece.n_docs == 1:
        breaks = np.flatnonzero(_BREAK[piece.data[SLICE_BYTES:]])
        if not len(breaks):
            break
        at = SLICE_BYTES + int(breaks[0]) + 1
        yield TextSlice(piece.data[:at], np.array([0, at]))
        piece = TextSlice(piece.data[at:], np.array([0, len(piece.data) - at]))
    yield piece


def _words(piece: TextSlice) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code and piece number of each word of a slice, and the distinct words by code, ASCII letters in lower case."""
    data = _LOWER[piece.data]
    stops = _BREAK[data]
    inside = ~(stops | _SPACE[data])
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[piece.offsets] = True  # a document's words never join the next document's
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    of = np.cumsum(stops | first[:n], dtype=np.int32)[start]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), of, coded.dictionary


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, TextSlice]]:
    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            for _, piece in column_slices(batch.column(1).filter(pc.equal(langs, lang)), SLICE_BYTES):
                for part in _parts(piece):
                    if len(part.data):
                        yield lang, part


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, part in _slices(batches):
        codes, _, words = _words(part)
        if len(words):
            counts = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), words.cast(pa.string()), pa.array(counts)], names=["lang", "phrase", "f"])


def _hash(lang: str, words: Sequence[str]) -> np.ndarray:
    """64-bit hashes of words of a language; they deal out and filter, they never decide what is equal."""
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _bits(n_bits: int):
    """mapInArrow function: the filter's bit that each (lang, phrase) sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [i for i, x in enumerate(langs) if x == lang]
                out[own] = (_hash(lang, [words[i] for i in own]) % np.uint64(n_bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out + 1)], names=["bit"])  # the bitmap functions count from 1

    return run


def _bitmap(words: DataFrame, n_bits: int) -> np.ndarray:
    """One bit for each hash of words: n_bits bits in all, whatever the number of words."""
    bits = words.select("lang", "phrase").mapInArrow(_bits(n_bits), "bit long").select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
    out = np.zeros(n_bits // 8 + 4096, dtype=np.uint8)
    # a bucket has the bits of 4096 bytes; the driver gets n_bits bits at most
    for row in bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap")).collect():
        at = (row.bucket - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(row.bitmap, dtype=np.uint8)
    return out


def _pointers(filter_of, n_bits: int, hot_words: frozenset[tuple[str, str]], max_words: int):
    """mapInArrow function: the occurrence pointers of a slice, each projected to what follows it.

    A pointer is a frequent word's place, with the frequent words after it in its piece, max_words in all. Equal ones
    of a slice are one row with their count; those that no frequent word follows can't grow and are left out. prefix tells
    tasks apart: it hashes the first word, or, while words are hot, the words up to the first that isn't, and its last
    four bits say how many words in front are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = filter_of.value
        for lang, part in _slices(batches):
            codes, of, words = _words(part)
            hashes = _hash(lang, words.to_pylist())
            bit = (hashes % np.uint64(n_bits)).astype(np.int64)
            passing = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            names = words.filter(pa.array(passing))
            word = (np.cumsum(passing) * passing)[codes]  # passing words from 1, 0 for the others
            at = np.flatnonzero((word[:-1] > 0) & (word[1:] > 0) & (of[1:] == of[:-1]))
            if not len(at):
                continue
            columns, live = [word[at]], np.ones(len(at), dtype=bool)
            for d in range(1, max_words):
                to = np.minimum(at + d, len(word) - 1)
                live &= (at + d < len(word)) & (of[to] == of[at]) & (word[to] > 0)
                columns.append(np.where(live, word[to], 0))
            rows, counts = _distinct(columns, len(names) + 1)
            texts = [pc.take(names, pa.array(c - 1, mask=c == 0)) for c in rows]
            pointer = pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string()), null_handling="skip")
            is_hot = np.concatenate([[False], pc.is_in(names, pa.array([w for x, w in hot_words if x == lang], pa.large_string())).to_numpy(zero_copy_only=False)])
            hashes = np.concatenate([np.zeros(1, dtype=np.uint64), hashes[passing]])
            prefix, n_hot, ahead = hashes[rows[0]], np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=bool)
            for d, c in enumerate(rows):
                if d:
                    prefix = np.where(ahead, mix(prefix * np.uint64(0x9E3779B97F4A7C15) ^ hashes[c]), prefix)
                ahead &= is_hot[c]
                n_hot += ahead
            deal = (prefix >> np.uint64(5)).astype(np.int64) * 16 + n_hot
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array([lang] * len(pointer), pa.string()), pointer.cast(pa.string()), pa.array(counts)], names=["prefix", "lang", "pointer", "n"])

    return run


def _distinct(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below base, and how often each occurs."""
    key = columns[0].astype(np.int64)
    if base ** len(columns) < 1 << 63:
        for c in columns[1:]:
            key = key * base + c
    else:
        for c in columns[1:]:
            key = np.unique(key, return_inverse=True)[1] * base + c
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], counts


class _Growth:
    """Counts of phrases of two words and more from pointers in the order of (lang, pointer).

    In that order the pointers of a prefix are one run, and those of each word that extends it one run within that run:
    going through the rows is going through the prefixes depth first. extend() projects the pointers to the runs that
    are frequent and extends those by a further word. The run that is open at a batch's end goes on in the next, so
    memory doesn't grow with a prefix. A prefix of hot words alone has pointers in other tasks too: its count is a
    part, given out whatever it is and not pruned by."""

    def __init__(self, max_words: int, min_count: int) -> None:
        self.max_words, self.min_count = max_words, min_count
        #: by length: lang, phrase, count, and whether the count is a part
        self.open: dict[int, tuple[str, str, int, bool]] = {}
        self.out: list[tuple[str, str, int]] = []

    def close(self, length: int) -> None:
        lang, phrase, n, part = self.open.pop(length)
        if n >= self.min_count or part:
            self.out.append((lang, phrase, n))

    def extend(self, langs: np.ndarray, pointers: pa.Array, words: list[np.ndarray], hot: np.ndarray, n: np.ndarray, length: int = 2) -> None:
        """Count the runs of that many words; words has, by place, each pointer's words as numbers, 0 for none."""
        there = words[length - 1] > 0
        langs, pointers, words, hot, n = langs[there], pointers.filter(pa.array(there)), [w[there] for w in words], hot[there], n[there]
        if not len(n):
            return
        change = np.ones(len(n), dtype=bool)
        change[1:] = langs[1:] != langs[:-1]
        for w in words[:length]:
            change[1:] |= w[1:] != w[:-1]
        start = np.flatnonzero(change)
        count, part = np.add.reduceat(n, start), hot[start] >= length
        name = lambda run: (langs[start[run]], " ".join(pointers[int(start[run])].as_py().split(" ", length)[:length]))
        if length in self.open:
            if self.open[length][:2] == name(0):
                count[0] += self.open.pop(length)[2]
            else:
                self.close(length)
        grows = (count >= self.min_count) | part
        for run in np.flatnonzero(grows[:-1]):
            self.out.append((*name(run), int(count[run])))
        self.open[length] = (*name(-1), int(count[-1]), bool(part[-1]))
        grows[-1] = True
        if length < self.max_words:
            rows = np.repeat(grows, np.diff(np.append(start, len(n))))
            self.extend(langs[rows], pointers.filter(pa.array(rows)), [w[rows] for w in words], hot[rows], n[rows], length + 1)

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 3
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "phrase", "f"])


def _grow(max_words: int, min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growth = _Growth(max_words, min_count)
        for batch in batches:
            if batch.num_rows:
                prefix, langs, pointers, n = batch.columns
                parts = pc.split_pattern(pointers, " ")
                words = [_numbers(pc.list_element(pc.list_slice(parts, d, d + 1, return_fixed_size_list=True), 0)) for d in range(max_words)]
                growth.extend(np.array(langs.to_pylist(), dtype=object), pointers, words, prefix.to_numpy() & 15, n.to_numpy())
                yield growth.taken()
        for length in sorted(growth.open):
            growth.close(length)
        yield growth.taken()

    return run


def _numbers(words: pa.Array) -> np.ndarray:
    """Equal words get equal numbers from 1, null 0."""
    coded = words.dictionary_encode()
    return pc.fill_null(pc.add(coded.indices, 1), 0).to_numpy(zero_copy_only=False)


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10, filter_bits: int = 1 << 24, lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to max_words words with f >= min_count, and (lang, n): each language's words.

    Frequent words are counted first. Each frequent word's occurrences are then projected to pointers that hold the
    frequent words behind it, and dealt to tasks by that prefix: its pointers meet in one task, in order, where
    phrases grow to the right depth first. Hot words, with more occurrences than a quarter of a task's share, are extended by a word before
    they are dealt out, by two where that one is hot as well, and so on; counts of phrases of hot words alone are added up over tasks.
    There are no more hot words than four a shuffle partition. A filter of filter_bits bits tells tasks which words may be
    frequent; it only ever lets too many through, more of them as words outnumber its bits. max_words is 15 at most."""
    spark = docs.sparkSession
    taken = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, _ = written(taken.mapInArrow(_count_words, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    frequent = words.where(F.col("f") >= min_count)
    share = (words.agg(F.sum("f")).first()[0] or 0) / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = frozenset((r["lang"], r["phrase"]) for r in frequent.where(F.col("f") > share).collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(frequent, filter_bits))
    pointers = taken.mapInArrow(_pointers(bitmap, filter_bits, hot, max_words), "prefix long, lang string, pointer string, n long")
    dealt = pointers.repartition("prefix").sortWithinPartitions("lang", "pointer")
    grown = dealt.mapInArrow(_grow(max_words, min_count), "lang string, phrase string, f long")
    longer = grown.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    phrases = frequent.unionByName(longer).withColumn("words", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    return written(phrases)[0], cut(words.groupBy("lang").agg(F.sum("f").alias("n")))


#: Counts and their products are exact up to 38 digits: 10**16 occurrences of a phrase.
_BIG = "decimal(38,0)"


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, contained_percent: int = 50, scale: int = 1_000_000, filter_bits: int = 1 << 24, lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases of 2 to max_words words.

    a is the phrase's count, at least min_count. Cutting it in two gives counts l and r and the score
    floor(scale * a * a / (l * r)); its lowest-scoring cut counts, ties to the first. A phrase inside a longer one that
    occurs at least contained_percent as often is dropped, however the longer one fares. Phrases stand by score, then by a, both
    descending, then by their UTF-8 bytes. n is the language's number of words.

    Takes text and lang; others are ignored. Defined cases: a null text has no words; a null lang is ``und``, one
    language with rows that say so; repeated rows count again; words are kept byte for byte but for A-Z, also characters that
    look like white space but aren't space or tab; a single piece of a text (between two of ``.,;:!?`` and line ends) longer than a slice is handled whole; no rows
    give no phrases."""
    phrases, totals = phrase_counts(docs, max_words, min_count, filter_bits, lang)
    candidates = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    # what each longer phrase contains, as the most frequent one that contains it
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: joined(i, m))))
    inside = candidates.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("f").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("f"))).drop("longer")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("left"), joined(k + 1, F.col("words") - k).alias("right")))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    counts = phrases.select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"cast({scale} * cast(a as {_BIG}) * cast(a as {_BIG}) as {_BIG}) div cast(cast(l as {_BIG}) * cast(r as {_BIG}) as {_BIG})").cast("long")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    placed = ranked(lowest.withColumn("_g", F.col("lang")), [F.desc("score"), F.desc("a"), F.asc("phrase")]).where(F.col("_pos") < top)
    return placed.join(totals, "lang").select("lang", (F.col("_pos") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
