"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


class TokenIds:
    """Token ids of a byte-level BPE, as the tokenizers library gives them.

    The same vocabulary in tiktoken's form is several times as fast; texts that hold a special token's
    string, or that tiktoken refuses, go through tokenizers itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(json_path)
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> np.ndarray:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self._special):
            return self.slow(text)
        try:
            return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=())).astype(np.uint32, copy=False)
        except Exception:  # its regular expression has a stack limit
            return self.slow(text)


@lru_cache(maxsize=2)
def token_ids(json_path: str, ranks_path: str, pattern: str) -> TokenIds:
    return TokenIds(json_path, ranks_path, pattern)


class Packer:
    """Windows of one task by fill level. counts[h] partly filled windows hold h tokens.

    A piece goes to the level where the sum of squared counts grows least, ties to the fullest."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def choose(self, size: int) -> int:
        """The level that a piece of size tokens, fewer than the capacity, goes to; 0 opens a window."""
        n = self.counts
        levels = np.flatnonzero(n[1 : self.capacity - size + 1]) + 1
        new = 2 * n[size] + 1
        if not len(levels):
            return 0
        after = np.where(levels + size < self.capacity, 2 * n[levels + size] + 1, 0)
        # a piece as large as its level moves out of it: that level then has one window fewer
        cost = 1 - 2 * n[levels] + after
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return int(levels[best]) if cost[best] <= new else 0

    def put(self, piece: tuple, size: int) -> list | None:
        """Place a piece; its window, if that is now full."""
        level = 0 if size == self.capacity else self.choose(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.counts[level + size] += 1
        self.open[level + size].append(window)
        return None

    def rest(self) -> Iterator[list]:
        """Windows left at the end, made full by cutting the emptiest ones up; only the last may stay partly filled."""
        windows = [w for level in reversed(range(1, self.capacity)) for w in self.open[level]]
        spare: list[tuple] = []
        lo, hi = 0, len(windows) - 1
        while lo <= hi:
            window, fill = windows[lo], sum(p[2] for p in windows[lo])
            lo += 1
            while fill < self.capacity and (spare or lo <= hi):
                if not spare:
                    spare, hi = windows[hi][::-1], hi - 1
                doc, start, length, ids, total = spare.pop()
                take = min(length, self.capacity - fill)
                window.append((doc, start, take, ids[:take], total))
                if take < length:
                    spare.append((doc, start + take, length - take, ids[take:], total))
                fill += take
            yield window
        if spare:
            yield spare[::-1]


FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _pack(capacity: int, end_id: int, paths: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = token_ids(*paths), Packer(capacity)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        out: list[tuple] = []
        kind = None

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length, ids, total in window:
                out.append((doc, start, length, zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, sequence, offset))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=kind)] + [pa.array(c, type=t) for c, (_, t) in zip(columns[1:], FIELDS, strict=True)], names=["doc_id"] + [n for n, _ in FIELDS])

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                ids = np.append(encode(batch.column(1)[i].as_py() or ""), np.uint32(end_id)).astype(np.uint32)
                doc, total = batch.column(0)[i].as_py(), len(ids)
                for start in range(0, total, capacity):
                    own = ids[start : start + capacity]
                    if window := packer.put((doc, start, len(own), own.copy(), total), len(own)):
                        emit(window)
                if len(out) >= 8192:
                    yield flush()
        if kind is not None:
            for window in packer.rest():
                emit(window)
            yield flush()

    return run


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, json_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most capacity tokens.

    A document is its token ids and then end_id. Full windows are cut from its start; the rest is one
    online item of the sum-of-squares packing that each task runs over its own rows, without a shuffle.
    When a task ends, its partly filled windows are made full by cutting the emptiest up, so that only
    one sequence of a task can need padding. Returns, per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id and offset. sequence_id holds the task's number above bit 40, so a task that
    runs again gives the same rows.

    Takes doc_id and text; others are ignored. Defined cases: a null or empty text is end_id alone; rows
    that repeat a doc_id are packed each; no rows give no pieces."""
    import public_tokenizers as public

    paths = (json_path or public.path("byte_bpe_50k.json"), ranks_path or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pack(capacity, end_id, paths), f"doc_id {kind}, " + ", ".join(f"{n} long" for n, _ in FIELDS))
