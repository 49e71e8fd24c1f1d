"""Near-duplicate vectors: int8 tile products with rigorous error bounds, exact where they can't decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, tile_pairs
from .jaccard import forest
from .staging import cut

#: Slack for the rounding of the bound's own arithmetic, far above it.
_SLACK = 1e-6


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales, the norms of what the codes miss, and the codes' own norms."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - decoded, axis=1), np.linalg.norm(decoded, axis=1)


def possible(left: tuple, right: tuple, threshold: float) -> np.ndarray:
    """Pairs whose cosine may reach the threshold: |u.v - s_u s_v q_u.q_v| <= |e_u| + |u^| |e_v| for unit u, v."""
    (qa, sa, ea, na), (qb, sb, eb, _) = left, right
    width = 1024  # float32 holds sums of 1024 products of int8 codes exactly
    dots = np.zeros((len(qa), len(qb)))
    for lo in range(0, qa.shape[1], width):
        dots += qa[:, lo : lo + width].astype(np.float32) @ qb[:, lo : lo + width].astype(np.float32).T
    dots *= sa[:, None]
    dots *= sb[None, :]
    return dots + ea[:, None] + na[:, None] * eb[None, :] + _SLACK >= threshold


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf.low.iloc[0]), int(pdf.high.iloc[0])
        pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
        x = np.stack(pdf.vector.to_list()).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # a power-free rescaling, so that no square overflows
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / norm[:, None]
        codes = quantise(unit)
        tiles, copies = pdf.tile.to_numpy(), pdf.copies.to_numpy()
        left, right = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
        n = len(pdf)
        linked = np.zeros((n, n), dtype=bool)
        if len(left) and len(right):
            maybe = possible(tuple(c[left] for c in codes), tuple(c[right] for c in codes), threshold)
            i, j = np.nonzero(maybe)
            for at in range(0, len(i), 65536):
                a, b = left[i[at : at + 65536]], right[j[at : at + 65536]]
                exact = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b])
                near = exact >= threshold
                linked[a[near], b[near]] = True
            linked |= linked.T
            np.fill_diagonal(linked, False)
        links = linked @ copies
        root = forest(linked)
        some = links > 0
        return pd.DataFrame({"node": pdf.node[some], "links": links[some], "root": pdf.node.to_numpy()[root[some]]})

    return run


def _usable(vector: Column) -> Column:
    """Not null, finite in every component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = 512) -> DataFrame:
    """Links between vectors of equal label whose cosine is at least the threshold, in double precision.

    Takes vec_id, embedding and label (others are ignored). Returns one row per row of vectors with
    vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable by links,
    itself included) and kept (vec_id = component_id).

    Equal vectors of a label become one node. Each label's nodes are dealt to tiles, and each pair of
    tiles is one task's work: an int8 product bounds every cosine, and only pairs that may reach the
    threshold are computed in double precision. A task returns link counts and a spanning forest, so
    rows grow with the tiles and not with the pairs.

    Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links
    with nothing, nor does one whose label is null or one of another dimension. Repeated rows
    link with each other."""
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", "label", vector.alias("vector"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & _usable(F.col("vector")))
    rows = cut(rows.select("vec_id", "label", F.when(F.col("usable"), F.col("vector")).alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("label", F.size("vector"), "vector"))))
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = cut(nodes.withColumn("dims", F.size("vector")))
    dealt = tile_pairs(nodes.drop("least_id"), ["label", "dims"], tile_rows, "node")
    found = cut(dealt.groupBy("label", "dims", "low", "high").applyInPandas(_compare(threshold), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("linked"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    resolved = nodes.select("node", "copies", "least_id").join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = resolved.join(resolved.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").select("node", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
