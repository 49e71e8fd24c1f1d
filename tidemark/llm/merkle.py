"""Merkle manifests of a dataset: roots, proofs as parent preimages, and folding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .staging import written

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest.
DIGEST = 64


def encoded(value: Column) -> Column:
    """A value so that no two sequences of values look alike: its UTF-8 bytes' count, a colon, the value; - for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _blocks(nodes: DataFrame, arity: int, height: int, more: Sequence[str] = ()) -> DataFrame:
    """The blocks of arity ** height consecutive nodes of a group: their parents' preimages by level, and their top.

    nodes has _g, _pos, _n and _node; each block keeps its nodes (with the columns more) as _entries. A block has
    no more than its fixed number of rows, whatever the group's size."""
    size = arity**height
    entry = F.struct((F.col("_pos") % size).cast("int").alias("i"), F.col("_node").alias("node"), *more)
    out = nodes.groupBy("_g", F.floor(F.col("_pos") / size).alias("_pos")).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(entry)).alias("_entries"))
    levels = sum((F.when(F.col("_n") > arity**j, 1).otherwise(0) for j in range(height)), F.lit(0))
    steps = F.filter(F.array(*[F.lit(j) for j in range(1, height + 1)]), lambda j: j <= levels)

    def preimages(children: Column) -> Column:
        last = F.floor((F.size(children) - 1) / arity).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(children, i * arity + 1, arity), ""))

    def up(state: Column, _: Column) -> Column:
        parents = preimages(state.nodes)
        return F.struct(F.transform(parents, lambda p: F.sha2(p, 256)).alias("nodes"), F.concat(state.levels, F.array(parents)).alias("levels"))

    start = F.struct(F.transform("_entries", lambda e: e.node).alias("nodes"), F.array().cast("array<array<string>>").alias("levels"))
    built = F.aggregate(steps, start, up)
    return out.withColumn("_built", built).select("_g", "_pos", F.ceil(F.col("_n") / size).alias("_n"), F.col("_built.nodes")[0].alias("_node"), F.col("_built.levels").alias("_levels"), "_entries")


def _tree(nodes: DataFrame, arity: int, height: int, more: Sequence[str] = ()) -> list[DataFrame]:
    """The tables of blocks, tier by tier, up to one node in each group; each is written."""
    most, tiers = nodes.agg(F.max("_n")).first()[0] or 1, []
    while True:
        tiers.append(written(_blocks(nodes, arity, height, () if tiers else more))[0])
        most = -(-most // arity**height)
        if most <= 1:
            return tiers
        nodes = tiers[-1].select("_g", "_pos", "_n", "_node")


def _paths(tiers: list[DataFrame], above: DataFrame, arity: int, height: int, kept: Sequence[str]) -> DataFrame:
    """The entries of the lowest tier with _path: their ancestors' preimages from below, and their slot in each.

    above has the path of each group's top (_g, _pos 0, _path) and the columns kept, which go down with it. Going
    down a tier, a block meets the path of its top once, whole, and hands it to its entries."""
    size = arity**height
    for blocks in reversed(tiers):
        met = blocks.select("_g", "_pos", "_levels", "_entries").join(above, ["_g", "_pos"])
        met = met.select("*", F.explode("_entries").alias("_e"))
        # level l of the block: the parent of entry i is number i / arity**(l + 1), where its child has slot i / arity**l
        own = F.transform("_levels", lambda parents, level: F.struct(
            F.get(parents, F.floor(F.col("_e.i") / F.pow(F.lit(arity), level + 1)).cast("int")).alias("preimage"),
            (F.floor(F.col("_e.i") / F.pow(F.lit(arity), level)) % arity).cast("int").alias("slot"),
        ))
        above = met.select("_g", (F.col("_pos") * size + F.col("_e.i")).alias("_pos"), F.concat(own, "_path").alias("_path"), *kept, "_e")
        out, above = above, above.drop("_e")
    return out


def siblings(path: Column) -> Column:
    """The digests beside the path, from below and left to right: each preimage without the path's own slot."""
    return F.transform(path, lambda p: F.concat(F.substring(p.preimage, F.lit(1), p.slot * DIGEST), F.substring(p.preimage, (p.slot + 1) * DIGEST + 1, F.length(p.preimage))))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to: into each preimage the digest so far is put at its slot, and the whole hashed."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(F.substring(p.preimage, F.lit(1), p.slot * DIGEST), node, F.substring(p.preimage, (p.slot + 1) * DIGEST + 1, F.length(p.preimage))), 256))


def merkle_proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", altered: Mapping[str, Column] | None = None, arity: int = 2, height: int = 6) -> DataFrame:
    """One row per row of docs: the order column, leaf, subroot (of its group), root and path; with altered also altered_leaf.

    A leaf is the digest of its fields. In each group leaves stand by order; arity consecutive nodes (fewer at the
    end, even one) make a parent, whose preimage is their digests concatenated, until one node is left, the
    subroot. Subroots by group (null first, by UTF-8 bytes) make the root likewise. path holds the preimages of all ancestors from below and
    the slot of 64 characters that the row's branch has in each; siblings() and fold() read it. altered replaces
    fields: altered_leaf is the leaf that the row then has.

    Parents are stored in blocks of height levels, so that a row of a block meets its ancestors by one join of
    blocks a tier, and no group meets in one task, however large. Shuffled are digests alone.

    Defined cases: nulls in any field are part of the leaf; a null order value stands first; rows that repeat an
    order value stand by their leaves, repeated rows next to each other, each with its own proof; a group of one row has its leaf
    as subroot, and if there is one group its subroot is the root; no rows give no proofs. Columns of docs other than those named aren't read."""
    values = {c: F.col(c) for c in dict.fromkeys([*fields, group, order])}
    leaf = leaf_digest([values[c] for c in fields])
    other = leaf_digest([(altered or {}).get(c, values[c]) for c in fields]) if altered else F.lit(None).cast("string")
    text = values[group].cast("string")
    leaves = docs.select(F.when(text.isNull(), "0").otherwise(F.concat(F.lit("1"), text)).alias("_g"), values[order].alias("_order"), leaf.alias("_node"), other.alias("_other"))
    tiers = _tree(ranked(leaves, [F.col("_order").asc_nulls_first(), F.col("_node").asc()]), arity, height, ("_order", "_other"))
    # one node for each group is left; they make a tree of their own
    subroots = tiers[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_of"), "_node")
    top = _tree(ranked(subroots, [F.col("_of").asc()]), arity, height, ("_of",))
    root = top[-1].select("_g", F.lit(0).cast("bigint").alias("_pos"), F.array().cast("array<struct<preimage string, slot int>>").alias("_path"), F.col("_node").alias("root"))
    groups = _paths(top, root, arity, height, ["root"])
    groups = groups.select(F.col("_e._of").alias("_g"), F.lit(0).cast("bigint").alias("_pos"), "_path", "root", F.col("_e.node").alias("subroot"))
    out = _paths(tiers, groups, arity, height, ["root", "subroot"])
    columns = [F.col("_e._order").alias(order), F.col("_e.node").alias("leaf"), "subroot", "root", F.col("_path").alias("path")]
    return out.select(*columns, *([F.col("_e._other").alias("altered_leaf")] if altered else []))
