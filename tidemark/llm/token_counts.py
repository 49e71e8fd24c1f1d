"""Edit-aware token counts: pre-token segment trees whose edited regions alone are encoded again."""

from __future__ import annotations

import base64
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import written

#: Pre-tokens in a leaf; a leaf splits at twice as many.
LEAF = 64
#: Pre-tokens before an edit that are cut anew: one whose text changed, one whose end looks at what follows.
CONTEXT = 2
CACHED = 200_000


class PreTokens:
    """A tokenizer's pre-tokens and their token counts, the latter cached."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self._known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            if len(self._known) >= CACHED:
                self._known.clear()
            n = self._known[piece] = len(self._encode(piece))
        return n


@lru_cache(maxsize=2)
def pre_tokens(ranks_path: str, pattern: str) -> PreTokens:
    return PreTokens(ranks_path, pattern)


class Leaf:
    """Some consecutive pre-tokens with their token counts; read from a stored tree, they are unpacked when first looked at."""

    __slots__ = ("_counts", "_pieces", "_stored", "chars", "tokens")

    def __init__(self, pieces: list[str] | None, counts: list[int] | None, chars: int, tokens: int, stored: tuple[pa.StructArray, int] | None = None) -> None:
        self._pieces, self._counts, self.chars, self.tokens, self._stored = pieces, counts, chars, tokens, stored

    def _open(self) -> None:
        if self._pieces is None:
            leaves, i = self._stored
            text, at = leaves.field("text")[i].as_py(), 0
            self._pieces, self._counts = [], leaves.field("counts")[i].as_py()
            for n in leaves.field("sizes")[i].as_py():
                self._pieces.append(text[at : at + n])
                at += n

    @property
    def stored_at(self) -> int | None:
        """The place of a stored leaf among its batch's, if it has one."""
        return self._stored[1] if self._stored else None

    @property
    def pieces(self) -> list[str]:
        self._open()
        return self._pieces

    @property
    def counts(self) -> list[int]:
        self._open()
        return self._counts


class Node:
    """A leaf with the subtrees before and after it, and the subtree's leaves, characters and tokens."""

    __slots__ = ("chars", "leaf", "left", "n", "right", "tokens")

    def __init__(self, leaf: Leaf, left: Node | None = None, right: Node | None = None) -> None:
        self.leaf, self.left, self.right = leaf, left, right
        self.update()

    def update(self) -> Node:
        self.n, self.chars, self.tokens = 1, self.leaf.chars, self.leaf.tokens
        for side in (self.left, self.right):
            if side:
                self.n += side.n
                self.chars += side.chars
                self.tokens += side.tokens
        return self


def balanced(leaves: list[Leaf]) -> Node | None:
    if not leaves:
        return None
    i = len(leaves) // 2
    return Node(leaves[i], balanced(leaves[:i]), balanced(leaves[i + 1 :]))


def split(tree: Node | None, n: int) -> tuple[Node | None, Node | None]:
    """The tree's first n leaves and the rest."""
    if tree is None:
        return None, None
    before = tree.left.n if tree.left else 0
    if n <= before:
        first, tree.left = split(tree.left, n)
        return first, tree.update()
    tree.right, rest = split(tree.right, n - before - 1)
    return tree.update(), rest


def merge(a: Node | None, b: Node | None, rng: random.Random) -> Node | None:
    """Both trees' leaves, a's first; the root is drawn by the trees' sizes, which keeps the depth logarithmic."""
    if a is None or b is None:
        return a or b
    if rng.random() * (a.n + b.n) < a.n:
        a.right = merge(a.right, b, rng)
        return a.update()
    b.left = merge(a, b.left, rng)
    return b.update()


class CountTree:
    """A document's pre-tokens in the leaves of a balanced tree of character and token sums.

    An edit finds its place by descending the sums, cuts the pre-tokens from CONTEXT before it until the new
    cuts meet the old ones again, counts the new ones alone, and puts leaves of at most 2 * LEAF pre-tokens in
    the place of those it touched; only sums above them change."""

    def __init__(self, leaves: list[Leaf], source: PreTokens) -> None:
        self.source, self.counted, self.touched, self.rng = source, 0, 0, random.Random(0)
        self.root = balanced(leaves) or Node(Leaf([], [], 0, 0))

    @classmethod
    def of_text(cls, text: str, source: PreTokens) -> CountTree:
        pieces = source.pattern.findall(text)
        return cls(_leaves(pieces, list(map(source.count, pieces))), source)

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def length(self) -> int:
        return self.root.chars

    def leaves(self) -> Iterator[Leaf]:
        stack, node = [], self.root
        while stack or node:
            while node:
                stack.append(node)
                node = node.left
            node = stack.pop()
            yield node.leaf
            node = node.right

    def text(self) -> str:
        return "".join(p for leaf in self.leaves() for p in leaf.pieces)

    def _leaf(self, i: int) -> Leaf:
        node = self.root
        while True:
            before = node.left.n if node.left else 0
            if i == before:
                return node.leaf
            node, i = (node.left, i) if i < before else (node.right, i - before - 1)

    def _leaf_of(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, or the last, and where that leaf begins."""
        node, i, begin = self.root, 0, 0
        while True:
            n, chars = (node.left.n, node.left.chars) if node.left else (0, 0)
            if at < begin + chars:
                node = node.left
            elif at < begin + chars + node.leaf.chars or not node.right:
                return i + n, begin + chars
            else:
                i, begin, node = i + n + 1, begin + chars + node.leaf.chars, node.right

    def edit(self, at: int, delete: int, insert: str) -> int:
        """Replace delete characters from at by insert; the number of pre-tokens counted again."""
        at = max(0, min(at, self.length))
        delete = max(0, min(delete, self.length - at))
        first, here = self._leaf_of(at)
        leaf, own = self._leaf(first), 0
        while own < len(leaf.pieces) and here + len(leaf.pieces[own]) < at:
            here += len(leaf.pieces[own])
            own += 1
        back = CONTEXT
        while back and (own or first):
            if not own:
                first -= 1
                leaf = self._leaf(first)
                own = len(leaf.pieces)
                continue
            own -= 1
            here -= len(leaf.pieces[own])
            back -= 1
        kept, kept_counts = leaf.pieces[:own], leaf.counts[:own]
        # characters from here to the edit stay; what the edit deletes isn't looked at
        end = at + delete
        head, i = "".join(leaf.pieces[own:]), first
        while here + len(head) < at:
            i += 1
            head += "".join(self._leaf(i).pieces)
        last, begin = self._leaf_of(end)
        tail, tail_counts = self._leaf(last).pieces, self._leaf(last).counts
        if last <= first:
            last, begin, tail, tail_counts = first, here, leaf.pieces[own:], leaf.counts[own:]
        front, more = head[: at - here] + insert, 1
        while True:
            is_last = last + 1 >= self.root.n
            fresh, met = self._cut(front, tail, end - begin, is_last)
            if met is not None:
                break
            # twice as many leaves each time, so that cutting anew adds up to a few times the last cut
            for _ in range(min(more, self.root.n - 1 - last)):
                last += 1
                tail, tail_counts = tail + self._leaf(last).pieces, tail_counts + self._leaf(last).counts
            more *= 2
        new = _leaves(kept + fresh + tail[met:], kept_counts + list(map(self.source.count, fresh)) + tail_counts[met:])
        before, rest = split(self.root, first)
        _, after = split(rest, last + 1 - first)
        self.root = merge(merge(before, balanced(new), self.rng), after, self.rng) or Node(Leaf([], [], 0, 0))
        self.counted += len(fresh)
        self.touched += last + 1 - first
        return len(fresh)

    def _cut(self, front: str, tail: list[str], skip: int, is_last: bool) -> tuple[list[str], int | None]:
        """Pre-tokens of front and the text of tail from character skip on, up to where they meet a cut of tail, and how many of tail are before that."""
        cuts, place = {}, 0
        for i, p in enumerate(tail):
            if place >= skip:
                cuts[place - skip + len(front)] = i
            place += len(p)
        fresh: list[str] = []
        for m in self.source.pattern.finditer(front + "".join(tail)[skip:]):
            if m.start() in cuts:
                return fresh, cuts[m.start()]
            fresh.append(m.group())
        return fresh, (len(tail) if is_last else None)


def _leaves(pieces: list[str], counts: list[int]) -> list[Leaf]:
    """Leaves of LEAF pre-tokens; 2 * LEAF at most stay in one."""
    size = LEAF if len(pieces) > 2 * LEAF else 2 * LEAF
    cut = [(pieces[i : i + size], counts[i : i + size]) for i in range(0, len(pieces), size)]
    return [Leaf(p, c, sum(map(len, p)), sum(c)) for p, c in cut]


LEAVES = "array<struct<text:string,sizes:array<int>,counts:array<int>,chars:int,tokens:int>>"
FIELDS = "tokens_before long, tokens_after long, chars_after long, pretokens_recounted long, leaves_touched long"
_LEAF = pa.struct([("text", pa.string()), ("sizes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("chars", pa.int32()), ("tokens", pa.int32())])


def _stored(texts: list[str], sizes: list[int], counts: list[int], bounds: list[int]) -> pa.StructArray:
    """Leaves of the texts given; sizes and counts of all their pre-tokens, of which a leaf's begin at its bound."""
    ends = pa.array(np.asarray(bounds, dtype=np.int32))
    flat = [np.asarray(x, dtype=np.int32) for x in (sizes, counts)]
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]
    sums = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in flat]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), *lists, *[pa.array(np.diff(x).astype(np.int32)) for x in sums]], fields=list(_LEAF))


#: Rows of a batch whose trees are held at once.
ROWS = 256


def _built(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = pre_tokens(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts, sizes, counts, bounds, rows = [], [], [], [0], [0]
                for text in batch.column(1).to_pylist():
                    pieces = source.pattern.findall(text or "")
                    sizes += map(len, pieces)
                    counts += map(source.count, pieces)
                    step = LEAF if len(pieces) > 2 * LEAF else 2 * LEAF
                    here = 0
                    for i in range(0, len(pieces), step):
                        there = here + sum(sizes[bounds[-1] : bounds[-1] + min(step, len(pieces) - i)])
                        texts.append(text[here:there])
                        bounds.append(bounds[-1] + min(step, len(pieces) - i))
                        here = there
                    rows.append(len(texts))
                leaves = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), _stored(texts, sizes, counts, bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), leaves], names=["doc_id", "edits", "leaves"])

    return run


def _edited(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = pre_tokens(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                bounds = np.cumsum([0, *batch.column(2).value_lengths().to_pylist()])
                leaves = batch.column(2).flatten()
                chars, tokens = leaves.field("chars").to_pylist(), leaves.field("tokens").to_pylist()
                out, places, rows = [], [], [0]
                texts, sizes, counts, ends = [], [], [], [0]
                for i, edits in enumerate(batch.column(1).to_pylist()):
                    tree = CountTree([Leaf(None, None, chars[j], tokens[j], (leaves, j)) for j in range(bounds[i], bounds[i + 1])], source)
                    before = tree.total
                    for e in edits or ():
                        tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                    out.append((before, tree.total, tree.length, tree.counted, tree.touched))
                    for leaf in tree.leaves():
                        if leaf.stored_at is not None:  # as it was
                            places.append(leaf.stored_at)
                            continue
                        places.append(len(leaves) + len(texts))
                        texts.append("".join(leaf.pieces))
                        sizes += map(len, leaf.pieces)
                        counts += leaf.counts
                        ends.append(len(sizes))
                    rows.append(len(places))
                columns = list(zip(*out, strict=True)) or [()] * 5
                pool = pa.concat_arrays([leaves.cast(_LEAF), _stored(texts, sizes, counts, ends)])
                after = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pool.take(pa.array(places, pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, pa.int64()) for c in columns] + [after], names=["doc_id", "tokens_before", "tokens_after", "chars_after", "pretokens_recounted", "leaves_touched", "leaves"])

    return run


def _tokenizer(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers as public

    return ranks_path or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN


def build_trees(docs: DataFrame, edits: Column | None = None, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The count tree of each document as a row: doc_id, edits (as given, for apply_edits) and leaves, to be stored.

    docs has doc_id and text; edits is an array of structs (at, delete, insert). A null text is empty."""
    edits = F.lit(None).cast("array<struct<at:bigint,delete:bigint,insert:string>>") if edits is None else edits
    plain = F.transform(edits, lambda e: F.struct(e["at"].cast("long").alias("at"), e["delete"].cast("long").alias("delete"), e["insert"].cast("string").alias("insert")))
    rows = docs.select("doc_id", "text", plain.alias("edits"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_built(*_tokenizer(ranks_path, pattern)), f"doc_id {kind}, edits {rows.schema['edits'].dataType.simpleString()}, leaves {LEAVES}")


def apply_edits(trees: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Stored trees (doc_id, edits, leaves) after their edits, without encoding the rest again.

    Edits apply in order, positions in characters of the text as edited so far. Returns doc_id, tokens_before,
    tokens_after, chars_after, pretokens_recounted, leaves_touched and the new leaves, to be stored in turn.

    Defined cases: null edits are none, null fields are 0 or empty; positions and lengths beyond the text are
    cut to it; rows that repeat a doc_id count each; special tokens' strings are ordinary text."""
    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.select("doc_id", "edits", "leaves").mapInArrow(_edited(*_tokenizer(ranks_path, pattern)), f"doc_id {kind}, {FIELDS}, leaves {LEAVES}")


def edited_counts(docs: DataFrame, edits: Column, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token counts of each document before and after its edits, by build_trees, stored, and apply_edits."""
    trees, _ = written(build_trees(docs, edits, ranks_path, pattern), compression="zstd")
    return apply_edits(trees, ranks_path, pattern).drop("leaves")


def sample_edits(n: int = 4) -> Column:
    """n edits of every document that follow from its doc_id and length alone: places, cuts and insertions of several kinds."""
    texts = F.array(*[F.lit(x) for x in (" one more sentence.", "", "x", "\n\n  ", "'ll", " 2024", " Ünï")])
    length = F.coalesce(F.length("text"), F.lit(0))

    def one(i: int) -> Column:
        draw = F.xxhash64(F.lit(i), "doc_id")
        return F.struct(F.pmod(draw, length + 1).alias("at"), F.pmod(F.shiftright(draw, 8), F.lit(12)).alias("delete"), F.element_at(texts, (F.pmod(F.shiftright(draw, 16), F.size(texts)) + 1).cast("int")).alias("insert"))

    return F.array(*[one(i) for i in range(n)])
