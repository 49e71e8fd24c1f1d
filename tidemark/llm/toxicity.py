"""Toxicity from the nearest labelled examples by exact weighted TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .staging import cut
from .textops import column_slices, shingle_sets, signed

_WORD = re.compile(r"[^\W\d_]+")
#: Rows of a batch that are held as Python strings at once.
ROWS = 500


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def text_terms(text: str | None) -> Counter:
    """Counts of a text's terms: its words in lower case."""
    return Counter(_WORD.findall((text or "").lower()))


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least five-word shingle hash of each text: near copies mostly share theirs."""
    for batch in batches:
        for first, piece in column_slices(batch.column(1)):
            sets, bounds = shingle_sets(piece, 5)
            least = [int(signed(sets[a : a + 1])[0]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, piece.n_docs) for i in range(3)] + [pa.array(least, pa.int64())], names=["doc_id", "text", "label", "family"])


def one_per_family(examples: DataFrame) -> DataFrame:
    """examples (doc_id, text, label) with one row of each family of near copies, so that a copied text's words don't pass for signs of its label."""
    kind = examples.schema["doc_id"].dataType.simpleString()
    marked = examples.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(_families, f"doc_id {kind}, text string, label int, family long")
    return marked.groupBy("family").agg(F.min_by(F.struct("doc_id", "text", "label"), F.struct("doc_id", "label", "text")).alias("e")).select("e.*")


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        found = [sorted(text_terms(t).items()) for t in batch.column(1).to_pylist()]
        terms = pa.array([[t for t, _ in own] for own in found], pa.list_(pa.string()))
        counts = pa.array([[n for _, n in own] for own in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), terms, counts], names=["doc_id", "label", "terms", "counts"])


def _frequencies(vocabulary: dict[str, int]):
    """Documents of the task that hold each term of the vocabulary, and the task's documents at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(len(vocabulary), dtype=np.int64)
        for batch in _parts(batches):
            for text in batch.column(0).to_pylist():
                own = [i for w in set(_WORD.findall((text or "").lower())) if (i := vocabulary.get(w)) is not None]
                seen[own] += 1
            total += batch.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], total))], names=["term", "n"])

    return run


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one after the other, and the ranges' lengths."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum()), size


class BlockMaxIndex:
    """Labelled unit vectors as postings by term and block of examples, with each block's largest weight of the term.

    A query's products with the blocks' maxima bound every similarity in a block from above; blocks are
    opened from the largest bound on, in groups that grow, until the bound can't beat the k-th nearest found:
    the k nearest are exact, to single precision. Examples that share their heaviest terms stand together, which
    keeps the bounds tight. Terms of a sixteenth of the examples or more are full rows instead of lists; what they
    add is known before any block is opened. Ties, to six digits, go to the example with the lower place."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_terms: int, block: int = 32) -> None:
        self.labels, self.block, self.n = labels, block, len(vectors)
        self.n_blocks = max(1, -(-self.n // block))
        terms = np.concatenate([t for t, _ in vectors]) if self.n else np.zeros(0, dtype=np.int64)
        weights = np.concatenate([w for _, w in vectors]).astype(np.float32) if self.n else np.zeros(0, dtype=np.float32)
        rows = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors]) if self.n else np.zeros(0, dtype=np.int64)
        frequent = np.flatnonzero(np.bincount(terms, minlength=n_terms) >= max(16, self.n // 16))
        self.slot = np.full(n_terms, -1, dtype=np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        here = self.slot[terms] >= 0
        self.full = np.zeros((len(frequent), self.n_blocks * block), dtype=np.float32)
        self.full[self.slot[terms[here]], rows[here]] = weights[here]
        terms, rows, weights = terms[~here], rows[~here], weights[~here]
        order = np.lexsort((rows, terms))
        terms, self.rows, self.weights = terms[order], rows[order].astype(np.int32), weights[order]
        blocks = self.rows // block
        new = np.ones(len(terms), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])
        first = np.flatnonzero(new)
        # an entry for each term and block: its postings and the largest of their weights
        self.entries = np.searchsorted(terms[first], np.arange(n_terms + 1)).astype(np.int32)
        self.at = np.append(first, len(terms)).astype(np.int32)
        self.of = blocks[first].astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else self.weights

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms with full rows add to the similarity of each query with each example."""
        rows = np.zeros((len(vectors), len(self.full)), dtype=np.float32)
        for row, (terms, weights) in zip(rows, vectors, strict=True):
            slots = self.slot[terms]
            row[slots[slots >= 0]] = weights[slots >= 0]
        return rows @ self.full

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarity and place of the k nearest examples with a positive similarity, but for skip. common, if known, is the query's row of common()."""
        if common is None:
            common = self.common([(terms, weights)])[0]
        slots = self.slot[terms]
        terms, weights = terms[slots < 0], weights[slots < 0]
        entries, size = _ranges(self.entries[terms], self.entries[terms + 1])
        blocks, weight = self.of[entries], np.repeat(weights, size)
        bound = np.bincount(blocks, weight * self.most[entries], minlength=self.n_blocks) + common.reshape(self.n_blocks, self.block).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        done, step = 0, 4
        best, ids = np.zeros(0), np.zeros(0, dtype=np.int64)
        chosen = np.zeros(self.n_blocks, dtype=bool)
        while done < len(order) and (len(best) < k or bound[order[done]] >= best[-1] - 1e-5):
            opened = order[done : done + step]
            chosen[:] = False
            chosen[opened] = True
            done, step = done + step, 4 * step
            here = chosen[blocks]
            own = entries[here]
            postings, size = _ranges(self.at[own], self.at[own + 1])
            score = np.bincount(self.rows[postings], np.repeat(weight[here], size) * self.weights[postings], minlength=len(common))
            inside = (opened[:, None] * self.block + np.arange(self.block)).reshape(-1)
            score = np.zeros(len(common)) + score
            score[inside] += common[inside]
            found = np.flatnonzero(score)
            found = found[found != skip]
            values = np.concatenate([best, score[found]])
            found = np.concatenate([ids, found])
            if len(values) > 4 * k:
                near = values >= np.partition(values, -k)[-k] - 2e-6
                values, found = values[near], found[near]
            top = np.lexsort((found, -np.round(values, 6)))[:k]
            best, ids = values[top], found[top]
        return best, ids


class ToxicityModel:
    """Bounded examples, weights of terms, and the vote's calibration.

    A term weighs (1 + ln tf) * idf * relevance. Relevance is how far the rate of label 1 among examples with
    the term, drawn towards the rate of all by belief examples, is from the latter in log odds: 0 for terms that
    no example has, so that every term of every text counts in the cosine with its weight."""

    def __init__(self, terms: list[str], frequency: np.ndarray, total: int, examples: list[tuple[object, np.ndarray, np.ndarray, int]], k: int, power: float, belief: float, calibrated_on: int) -> None:
        self.vocabulary = {t: i for i, t in enumerate(terms)}
        self.k, self.power, self.belief = k, power, belief
        self.idf = np.log((1 + total) / (1 + frequency)) + 1
        labels = np.array([y for *_, y in examples], dtype=float)
        held = np.concatenate([t for _, t, _, _ in examples])
        sizes = [len(t) for _, t, _, _ in examples]
        self.with_term = np.bincount(held, minlength=len(terms)).astype(float)
        self.with_label = np.bincount(held, np.repeat(labels, sizes), minlength=len(terms))
        self.base = float((labels.sum() + 1) / (len(labels) + 2))
        self.relevance = self._relevance(self.with_label, self.with_term)
        vectors = [(d, *self.unit(t, c, self.relevance[t]), y, t, c) for d, t, c, y in examples]
        some = [v for v in vectors if len(v[1])]
        some.sort(key=lambda e: (e[1][np.argsort(-e[2], kind="stable")[:8]].tolist(), str(e[0])))  # heaviest terms first
        none = [v[3] for v in vectors if not len(v[1])]
        self.ids = [v[0] for v in some]
        self.index = BlockMaxIndex([(t, w) for _, t, w, *_ in some], np.array([v[3] for v in some], dtype=float), len(terms))
        self.empty = (sum(none) + self.base) / (len(none) + 1)
        left_out = range(0, len(some), max(1, -(-len(some) // calibrated_on)))
        self.edges, self.levels = self._isotonic(np.array([self._without_itself(some[i], i) for i in left_out]), self.index.labels[list(left_out)])

    def _relevance(self, with_label: np.ndarray, with_term: np.ndarray) -> np.ndarray:
        rate = (with_label + self.belief * self.base) / (with_term + self.belief)
        rate = np.clip(rate, 1e-9, 1 - 1e-9)
        return np.abs(np.log(rate / (1 - rate)) - np.log(self.base / (1 - self.base)))

    def unit(self, terms: np.ndarray, counts: np.ndarray, relevance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms with a weight and their weights, of norm 1."""
        w = (1 + np.log(counts)) * self.idf[terms] * relevance
        some = w > 0
        return terms[some], w[some] / max(1e-300, np.sqrt((w * w).sum()))

    def _without_itself(self, example: tuple, place: int) -> float:
        """An example's vote as if its label weren't known."""
        _, _, _, y, t, c = example
        return self.vote(*self.unit(t, c, self._relevance(self.with_label[t] - y, self.with_term[t] - 1)), skip=place)[0]

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1, common: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of the nearest examples' weight, similarity ** power, that is labelled 1; the base rate counts as a faint example."""
        near, ids = self.index.nearest(terms, weights, self.k, skip, common)
        weight = near**self.power
        return float(((weight * self.index.labels[ids]).sum() + 0.01 * self.base) / (weight.sum() + 0.01)), near, ids

    @staticmethod
    def _isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of a non-decreasing line from left-out votes to the rate of label 1, level within pools of adjacent violators."""
        pools: list[list[float]] = []
        for v, y in sorted(zip(votes.tolist(), labels.tolist(), strict=True)):
            pools.append([v, v, y, 1.0])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        edges = np.array([x for p in pools for x in p[:2]])
        return edges, np.repeat([(p[2] + 0.5 * 0.1) / (p[3] + 0.1) for p in pools], 2)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        known = self.vocabulary
        own = {i: n for w, n in text_terms(text).items() if (i := known.get(w)) is not None}
        terms = np.fromiter(own.keys(), dtype=np.int64, count=len(own))
        return self.unit(terms, np.fromiter(own.values(), dtype=np.float64, count=len(own)), self.relevance[terms])

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list, list[float]]]:
        """Calibrated scores with their evidence: the nearest examples' ids and similarities."""
        vectors = [self.vector(t) for t in texts]
        for (terms, weights), common in zip(vectors, self.index.common(vectors), strict=True):
            if not len(terms):
                yield self.empty, [], []
                continue
            vote, near, ids = self.vote(terms, weights, common=common)
            level = np.interp(vote, self.edges, self.levels) if len(self.levels) else vote
            # the vote itself breaks ties where the line is level
            yield float(min(1.0, 0.98 * level + 0.02 * vote)), [self.ids[i] for i in ids[:3]], near[:3].tolist()


def _scored(model: ToxicityModel, ids: pa.DataType):
    types = [pa.float64(), pa.list_(ids), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            columns = list(zip(*model.scores(batch.column(1).to_pylist()), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "row", "score", "evidence", "similarity"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = 4_096, max_postings: int = 1_500_000, k: int = 15, power: float = 2.0, belief: float = 4.0, threshold: float = 0.3, calibrated_on: int = 2_000) -> DataFrame:
    """Score of every document with its evidence.

    docs has doc_id and text, labels doc_id and toxic (0, 1 or null: unlabelled). Returns doc_id, row (a key of
    doc_id and text), held_out, score, predicted (score >= threshold), evidence (doc_ids of the nearest examples) and similarity.

    Examples are labelled rows that aren't held out, one of each family of near copies, in order of a hash, up to
    max_examples labels and max_postings different terms of a text, summed; that bounds the index and what is
    broadcast. All their terms are indexed, with document frequencies over all documents. Every text goes to the
    exact k nearest examples by the cosine of all its terms' weights (ToxicityModel); their votes, weighted by
    similarity ** power, are calibrated by an isotonic fit on at most calibrated_on examples, each left out in
    turn. A text without any weighty term has the rate of label 1 among examples without.

    Defined cases: null and empty texts have no terms; without examples every score is 0.0, so that nothing is
    predicted; rows that repeat score alike; a doc_id labelled twice is learnt with one of the labels; null
    doc_ids aren't held out and have no label."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen = cut(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_examples))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    kind = docs.schema["doc_id"].dataType
    named, ids = kind.simpleString(), to_arrow_type(kind)
    examples = one_per_family(docs.drop("row").join(F.broadcast(chosen), "doc_id"))  # max_examples rows
    examples = examples.mapInArrow(_example_terms, f"doc_id {named}, label int, terms array<string>, counts array<int>")
    so_far = F.sum(F.size("terms")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    learnt = examples.withColumn("so_far", so_far).where(F.col("so_far") <= max_postings).drop("so_far").toArrow().combine_chunks()  # max_postings terms
    is_held = held_out(F.col("doc_id")).alias("held_out")
    if not learnt.num_rows:
        return docs.select("doc_id", "row", is_held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(f"array<{named}>").alias("evidence"), F.array().cast("array<double>").alias("similarity"))
    flat = learnt.column("terms").combine_chunks().flatten().dictionary_encode()
    bounds = np.cumsum([0, *learnt.column("terms").combine_chunks().value_lengths().to_pylist()])
    codes, counts = flat.indices.to_numpy().astype(np.int64), learnt.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64)
    terms = flat.dictionary.to_pylist()
    rows = [(d, codes[a:b], counts[a:b], y) for d, y, a, b in zip(learnt.column("doc_id").to_pylist(), learnt.column("label").to_pylist(), bounds[:-1], bounds[1:], strict=True)]
    seen = docs.select("text").mapInArrow(_frequencies({t: i for i, t in enumerate(terms)}), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    frequency = np.zeros(len(terms) + 1)
    frequency[seen.column("term").to_numpy()] = seen.column("n").to_numpy()  # -1, the last, is all documents
    model = ToxicityModel(terms, frequency[:-1], int(frequency[-1]), rows, k, power, belief, calibrated_on)
    scored = docs.mapInArrow(_scored(model, ids), f"doc_id {named}, row long, score double, evidence array<{named}>, similarity array<double>")
    return scored.select("doc_id", "row", is_held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "similarity")
