"""N-gram Jaccard join by MinHash banding: exact similarities, class ids and link counts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, tile_pairs
from .staging import cut, release
from .textops import column_slices, mix, shingle_sets, signed


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands of that many rows that catch a pair at the threshold with at least that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def corpus_secret(docs: DataFrame) -> tuple[int, int]:
    """Two 64-bit numbers that every text of docs takes part in."""
    total = docs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("text").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "text").cast("decimal(38,0)")).alias("b")).first()
    digest = hashlib.sha256(f"{total['n']}:{total['a']}:{total['b']}".encode()).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:16], "little")


def _signatures(k: int, bands: int, rows: int, seed: int, secret: tuple[int, int]):
    factors = np.random.default_rng(seed).integers(1, 2**63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, row = batch.column(0), batch.column(1), batch.column(2)
            for first, piece in column_slices(text):
                sets, bounds = shingle_sets(piece, k, secret)
                n = piece.n_docs
                some = np.flatnonzero(np.diff(bounds))
                out = np.zeros((n, bands), dtype=np.uint64)
                f1, f2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                if len(some):
                    at = bounds[some]
                    f1[some] = np.add.reduceat(mix(sets ^ np.uint64(0x243F6A8885A308D3)), at)
                    f2[some] = np.add.reduceat(mix(sets ^ np.uint64(0x13198A2E03707344)), at)
                    for b in range(bands):
                        band = np.full(len(some), b + 1, dtype=np.uint64) * np.uint64(0xA4093822299F31D1)
                        for r in range(rows):
                            low = np.minimum.reduceat((sets * factors[b * rows + r]) >> np.uint64(32), at)
                            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + low)
                        out[some, b] = band
                flat = pa.array(signed(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), row.slice(first, n), pa.array(signed(f1)), pa.array(signed(f2)), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)],
                    names=["doc_id", "row", "f1", "f2", "n_shingles", "bands"],
                )

    return run


def _shingles(k: int, secret: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, piece in column_slices(batch.column(1)):
                sets, bounds = shingle_sets(piece, k, secret)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(signed(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, piece.n_docs), lists], names=["node", "shingles"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right sets, by products of 0/1 tiles."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    terms, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1  # a shingle of one set meets nothing
    renumber = np.cumsum(counts > 1) - 1
    rows, cols = rows[keep], renumber[inverse[keep]]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    width = 8192
    for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, [lo, lo + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[rows[a:b], cols[a:b] - lo] = 1
        total += m[left] @ m[right].T
    return total.astype(np.int64)


def forest(linked: np.ndarray) -> np.ndarray:
    """Root of each row of a symmetric 0/1 adjacency matrix: the least index of its component."""
    n = len(linked)
    root = np.arange(n)
    seen = np.zeros(n, dtype=bool)
    for i in range(n):
        if seen[i]:
            continue
        front = np.zeros(n, dtype=bool)
        front[i] = True
        own = front.copy()
        while front.any():
            front = linked[front].any(axis=0) & ~own
            own |= front
        root[own] = i
        seen |= own
    return root


def _verify(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf.low.iloc[0]), int(pdf.high.iloc[0])
        pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
        sets = [np.asarray(s).view(np.uint64) for s in pdf.shingles]
        tiles, size, mult = pdf.tile.to_numpy(), np.array([len(s) for s in sets]), pdf.copies.to_numpy()
        n = len(sets)
        left, right = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
        linked = np.zeros((n, n), dtype=bool)
        if len(left) and len(right):
            both = _overlaps(sets, left, right)
            near = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            linked[np.ix_(left, right)] = near
            linked |= linked.T
            np.fill_diagonal(linked, False)
        links = linked @ mult
        root = forest(linked)
        some = links > 0
        return pd.DataFrame({"node": pdf.node[some], "links": links[some], "root": pdf.node.to_numpy()[root[some]]})

    return run


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = 0.999, rows: int = 6, tile_rows: int = 512, tile_shingles: int = 1_000_000, seed: int = 7, secret: tuple[int, int] | None = None) -> DataFrame:
    """Near-duplicate classes of documents: shingle sets of k words with Jaccard similarity of percent/100 or more.

    Takes columns doc_id and text (others are ignored); returns one row per row of docs with
    doc_id, row (a key of doc_id and text), n_shingles, n_links (other rows linked directly), class_id
    (least doc_id of all rows reachable by links), class_row (the row of the class's first document, by doc_id
    and row) and kept (doc_id = class_id).

    Rows with equal shingle sets are one node. Nodes that share a band hash of their MinHash
    signature are star-linked to the bucket's least node, which makes candidate groups; within a
    group all pairs are verified on their full shingle sets in tiles, of which only link counts and
    a spanning forest leave the task. The bands' count follows from the target recall, and pairs
    of a group that share no band are verified too. Tiles hold tile_rows nodes or tile_shingles shingles on average.
    Shingles are compared by 64-bit hashes with a secret; without one given it follows from the texts of all rows
    (corpus_secret), so that reruns agree and no one who doesn't know them all can write words that share a hash.

    Defined cases: a text of 1 to k-1 words has one shingle, its whole word sequence; a null, empty
    or blank text has none and links with nothing (class_id = doc_id). Null doc_ids take part; a class
    of null ids alone has class_id null and keeps all of them. Repeated rows link with each other and
    are kept or dropped together."""
    bands = choose_bands(percent / 100, recall, rows)
    secret = secret or corpus_secret(docs)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed_docs = cut(docs.mapInArrow(_signatures(k, bands, rows, seed, secret), f"doc_id {kind}, row long, f1 long, f2 long, n_shingles long, bands array<long>").withColumn("node", F.xxhash64("f1", "f2", "n_shingles")))
    some = signed_docs.where("n_shingles > 0")
    nodes = cut(some.groupBy("node").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("least"), F.min("row").alias("row"), F.first("bands").alias("bands")))
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    # cut, so that both sides of the join are plain shuffles, of which AQE may split a hot bucket's
    shared = cut(buckets.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    edges = buckets.join(shared, "band").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = cut(components(edges))
    chosen = cut(nodes.join(groups, "node").select("node", "component", "copies", "row", "n_shingles"))
    tiles = F.greatest(F.ceil(F.count("*") / F.lit(tile_rows)), F.ceil(F.sum("n_shingles") / F.lit(tile_shingles)))
    sizes = chosen.groupBy("component").agg(tiles.cast("int").alias("_tiles"))
    # the text of one row per node: rows of a node have equal sets, so any of them will do
    texts = docs.join(chosen.select("node", "row"), "row").select("node", "text")
    members = chosen.drop("n_shingles").join(texts.mapInArrow(_shingles(k, secret), "node long, shingles array<long>").dropDuplicates(["node"]), "node")
    dealt = tile_pairs(members, ["component"], tile_rows, "node", sizes)
    found = cut(dealt.groupBy("component", "low", "high").applyInPandas(_verify(percent), "node long, links long, root long"))
    release(docs.sparkSession)
    links = found.groupBy("node").agg(F.sum("links").alias("linked"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # cut, as it is read twice: the driver plans it once
    resolved = cut(nodes.select("node", "copies", "least").join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node")))
    named = resolved.join(resolved.groupBy("component").agg(F.min("least").alias("first")), "component").select("node", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class_row"))
    out = signed_docs.select("doc_id", "row", "n_shingles", "node").join(named, "node", "left")
    blank = F.col("n_shingles") == 0
    out = out.select("doc_id", "row", "n_shingles", F.when(blank, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(blank, F.col("row")).otherwise(F.col("class_row")).alias("class_row"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
