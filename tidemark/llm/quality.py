"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import cut
from .textops import RangeHash, TextSlice, column_slices, word_codes

GOOD, BAD, ABSTAIN = 1, -1, 0
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[np.frombuffer(b"!?", dtype=np.uint8)] = True

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[33:127] = True
_PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_END = np.zeros(256, dtype=bool)
_END[np.frombuffer(b".!?", dtype=np.uint8)] = True
_LOWER = _LETTER & ~_UPPER
#: Letters, and all that isn't ASCII.
_WORDLIKE = _LETTER.copy()
_WORDLIKE[128:] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_punctuation", "n_plain", "n_capital", "n_short", "n_ends", "n_distinct")


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _later_lines(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Lines equal, byte by byte, to an earlier line of their document."""
    order = np.lexsort((begin, hashes, docs))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = np.zeros(len(begin), dtype=bool)
    seen: dict[int, set[bytes]] = {}
    for i, j in zip(order[~new].tolist(), first[~new].tolist(), strict=True):
        known = seen.setdefault(j, {data[begin[j] : stop[j]].tobytes()})
        line = data[begin[i] : stop[i]].tobytes()
        later[i] = line in known
        known.add(line)
    return later


def measure(piece: TextSlice) -> dict[str, np.ndarray]:
    """The measures of each document of a slice, over its whole text."""
    data, offsets, n = piece.data, piece.offsets, piece.n_docs
    hashed = RangeHash(data)
    start, end, docs = piece.words()
    out = {"n_words": np.bincount(docs, minlength=n)}
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    out["word_chars"] = np.bincount(docs, weights=points[end] - points[start], minlength=n).astype(np.int64)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARK), ("n_punctuation", _PUNCTUATION)):
        out[name] = _per_doc(table[data], offsets)
    # lines: cut at \n and at document ends; those without a word don't count
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1])) if n else offsets[:0]
    begin = begin[begin <= len(data)]
    stop = np.append(begin[1:], len(data))
    stop = np.where((stop > 0) & np.isin(stop - 1, breaks, assume_unique=False), stop - 1, stop)
    stop = np.maximum(stop, begin)
    wordy = np.searchsorted(start, stop, side="left") > np.searchsorted(start, begin, side="left")
    begin, stop = begin[wordy], stop[wordy]
    line_docs = np.searchsorted(offsets, begin, side="right") - 1
    out["n_lines"] = np.bincount(line_docs, minlength=n)
    out["n_dup_lines"] = np.bincount(line_docs[_later_lines(data, begin, stop, line_docs, hashed.of(begin, stop))], minlength=n)
    count = lambda flags: np.bincount(docs, weights=flags, minlength=n)
    held = {}
    for name, table in (("wordlike", _WORDLIKE), ("upper", _UPPER), ("lower", _LOWER)):
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        held[name] = total[end] - total[start]
    long = points[end] - points[start]
    out |= {"n_plain": count(held["wordlike"] == 0), "n_capital": count((held["upper"] > 1) & (held["lower"] == 0)), "n_short": count(long <= 3), "n_ends": count(_END[data[end - 1]])}
    # words are told apart by their bytes, not by hashes that a text could be written to share
    words, distinct = word_codes(piece)
    out["n_distinct"] = np.bincount(np.unique(docs * distinct + words) // distinct, minlength=n)
    at = np.flatnonzero(docs[: max(0, len(docs) - 2)] == docs[2:])
    pairs = np.unique(words[at] * distinct + words[at + 1], return_inverse=True)[1] if len(at) else at
    windows, of = pairs * distinct + words[at + 2], docs[at]
    order = np.lexsort((windows, of))
    same = (windows[order][1:] == windows[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for j in range(3):
        covered[at[twice] + j] = True
    out["n_repeat_words"] = np.bincount(docs, weights=covered, minlength=n).astype(np.int64)
    return {m: out[m].astype(np.int64) for m in MEASURES}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, piece in column_slices(batch.column(1)):
            m = measure(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, piece.n_docs)] + [pa.array(m[k]) for k in MEASURES], names=["doc_id", *MEASURES])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every text; a null text has none of anything."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Rule:
    """A vote on a share (part / whole): good up to one bound, bad beyond another, none between; where the good bound is the larger, small shares are bad."""

    name: str
    part: str
    whole: str
    good: float
    bad: float


#: Several rules look at each fault from different sides, so that their agreement tells which of them to believe.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.2),
    Rule("punctuation", "n_punctuation", "word_chars", 0.06, 0.09),
    Rule("letterless", "n_plain", "n_words", 0.05, 0.3),
    Rule("repeats", "n_repeat_words", "n_words", 0.05, 0.2),
    Rule("distinct", "n_distinct", "n_words", 0.6, 0.5),
    Rule("lines", "n_dup_lines", "n_lines", 0.05, 0.3),
    Rule("capitals", "n_upper", "n_letters", 0.1, 0.3),
    Rule("capital_words", "n_capital", "n_words", 0.05, 0.3),
    Rule("marks", "n_marks", "n_words", 0.02, 0.2),
    Rule("word_length", "word_chars", "n_words", 6.0, 7.0),
    Rule("short_words", "n_short", "n_words", 0.25, 0.12),
    Rule("sentences", "n_ends", "n_words", 0.05, 0.02),
)


def _votes(rules: tuple[Rule, ...]) -> list[Column]:
    out = []
    for r in rules:
        share = F.when(F.col(r.whole) > 0, F.col(r.part) / F.col(r.whole))
        good, bad = (share <= r.good, share > r.bad) if r.good <= r.bad else (share >= r.good, share < r.bad)
        out.append(F.when(good, GOOD).when(bad, BAD).otherwise(ABSTAIN).cast("int").alias(f"vote_{r.name}"))
    return out


def gains(table: np.ndarray) -> np.ndarray:
    """What each rule's votes (bad, none, good) add to the log odds of quality: an abstention nothing, and a vote never against its own sense."""
    ratio = np.log(table[:, 1]) - np.log(table[:, 0])
    return np.stack([np.minimum(ratio[:, 0], 0), np.zeros(len(ratio)), np.maximum(ratio[:, 2], 0)], axis=1)


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Prior of quality and P(vote | class) of each rule by expectation-maximisation over vote patterns.

    patterns: one row per distinct combination of votes. EM starts where two bad votes make a document bad and
    one makes it doubtful; each class and vote counts one document more than were seen, so that nothing is
    impossible, and nothing else is believed beforehand.
    Returns the prior and an array [rule, class (bad, good), vote (bad, none, good)]."""
    counts = counts.astype(float)
    n_bad = (patterns == BAD).sum(axis=1)
    good = np.where(n_bad > 1, 0.05, np.where(n_bad == 1, 0.5, 0.95))
    prior, table = 0.5, np.zeros((patterns.shape[1], 2, 3))
    places = np.arange(patterns.shape[1])
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        for v in (BAD, ABSTAIN, GOOD):
            table[:, :, v + 1] = (weight @ (patterns == v)).T + 1
        table /= table.sum(axis=2, keepdims=True)
        log_odds = np.log(prior / (1 - prior)) + gains(table)[places, patterns + 1].sum(axis=1)
        after = 1 / (1 + np.exp(np.clip(-log_odds, -700, 700)))
        done, good = np.abs(after - good).max(initial=0) < 1e-9, after
        if done:
            break
    return prior, table


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, base: Callable[[], Column] | None = None) -> DataFrame:
    """Each document's measures, base_failed, quality (posterior probability) and kept.

    Takes doc_id and text. Rules vote on shares of the measures or abstain; the accuracies come from the
    counts of vote patterns over all documents that don't fail the base test, of which the driver sees
    3**rules at most. kept is false where the base test fails, else quality >= threshold.

    Defined cases: a null or empty text has measures 0 and fails the base test; rows that repeat stand
    for themselves; with no documents nothing is fitted."""
    votes = _votes(rules)
    failed = base() if base else (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = cut(measures(docs).withColumn("base_failed", failed).select("*", *votes))
    names = [f"vote_{r.name}" for r in rules]
    seen = rows.where("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).collect()  # 3**rules rows at most
    if not seen:
        return rows.drop(*names).withColumns({"quality": F.lit(None).cast("double"), "kept": F.lit(False)})
    prior, table = fit_accuracies(np.array([r[:-1] for r in seen]), np.array([r[-1] for r in seen]))
    log_odds = F.lit(float(np.log(prior / (1 - prior))))
    for name, gain in zip(names, gains(table).tolist(), strict=True):
        log_odds = log_odds + F.when(F.col(name) == BAD, gain[0]).when(F.col(name) == GOOD, gain[2]).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-log_odds))
    return rows.withColumn("quality", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*names)
