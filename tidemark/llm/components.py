"""Connected components and within-group pair work, both without a group ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import cut, release


def _closest(edges: DataFrame) -> DataFrame:
    """For each node u with its neighbours v: the smallest of them all, joined to each edge.

    A grouped minimum, combined before the shuffle and cut, and a join of two plain shuffles that AQE may
    split, so that a node with very many neighbours fills no single task."""
    low = cut(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return edges.join(low, "u")


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node u has one neighbour v, which has none itself: then v is the least node of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("down")).where("ups > 1 or ups > 0 and down = 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is its smallest node.

    Alternating large-star and small-star rounds until stars are left: the number of rounds grows with the logarithm
    of the component's size. Self loops are kept as components of one node. What the driver holds of a round's
    plans and shuffles is released before the next."""
    loops = edges.select(F.col(a).alias("node")).where(F.col(a) == F.col(b))
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    rounds = 0
    while not _is_forest(now):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _closest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())  # read twice
        small = _closest(large)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").distinct())
        release(edges.sparkSession)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return out.unionByName(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def tile_pairs(members: DataFrame, group: list[str], tile_rows: int, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """Deal each group's rows to tiles of about tile_rows and copy each row to every pair of tiles it is in.

    Adds tile (the row's own), low and high (the pair). sizes, if given, has each group's number of tiles as _tiles. A group of n rows gives n * n / tile_rows
    rows spread over (n / tile_rows)**2 / 2 tasks, never the pairs of rows themselves."""
    if sizes is None:
        sizes = members.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("_tiles"))
    dealt = members.join(sizes, group).withColumn("tile", F.pmod(F.xxhash64(key), F.col("_tiles").cast("long")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return dealt.withColumn("low", F.least("tile", "_other")).withColumn("high", F.greatest("tile", "_other")).drop("_other", "_tiles")
