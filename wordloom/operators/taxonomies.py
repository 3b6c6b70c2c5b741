"""Measures over a taxonomy ``child, parent``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def ancestors(edges: DataFrame) -> DataFrame:
    """``node, anc, d``: least number of steps up from every node to each ancestor, itself at 0.

    Each round goes one level up from what the last one found first, until there is nothing new.
    """
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    level = found = cut(nodes.select("node", F.col("node").alias("anc"), F.lit(0).alias("d")))
    up = edges.select(F.col("child").alias("anc"), "parent").distinct()
    while True:
        level = cut(level.join(up, "anc").select("node", F.col("parent").alias("anc"), (F.col("d") + 1).alias("d")).distinct().join(found, ["node", "anc"], "left_anti"))
        if not level.limit(1).count():
            return found
        found = cut(found.unionByName(level))


def rooted(edges: DataFrame, root: str = "*") -> DataFrame:
    """Edges with a root above all nodes that have no parent, so that any two nodes meet."""
    tops = edges.select(F.col("parent").alias("child")).distinct().join(edges.select("child"), "child", "left_anti")
    return edges.select("child", "parent").unionByName(tops.select("child", F.lit(root).alias("parent")))


def common(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """``s1, s2, anc, d1, d2``: the common ancestors of pairs."""
    return pairs.join(closure.select(F.col("node").alias("s1"), "anc", F.col("d").alias("d1")), "s1").join(closure.select(F.col("node").alias("s2"), "anc", F.col("d").alias("d2")), ["s2", "anc"])


def depths(closure: DataFrame) -> DataFrame:
    """``anc, depth``: steps from a node up to its farthest ancestor by shortest ways."""
    return closure.groupBy(F.col("node").alias("anc")).agg(F.max("d").alias("depth"))


def similarities(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Path, Leacock-Chodorow and Wu-Palmer similarity; null for pairs without a common ancestor.

    The taxonomy's depth is that of its deepest node. Of common ancestors the deepest subsumes for Wu-Palmer,
    ties to the nearest, then the smallest name.
    """
    depth = depths(closure)
    deepest = depth.agg(F.max("depth").alias("top"))
    both = common(pairs, closure).join(depth, "anc")
    got = both.groupBy("s1", "s2").agg(F.min(F.col("d1") + F.col("d2")).alias("dist"), F.min(F.struct((-F.col("depth")).alias("h"), (F.col("d1") + F.col("d2")).alias("s"), "anc", "d1", "d2")).alias("lcs"))
    out = pairs.join(got, ["s1", "s2"], "left").crossJoin(F.broadcast(deepest))
    h = -F.col("lcs.h") + 1
    return out.select("s1", "s2", "dist", (1 / (F.col("dist") + 1)).alias("path"), (-F.ln((F.col("dist") + 1) / (2.0 * F.greatest("top", F.lit(1))))).alias("lch"), (2 * h / (2 * h + F.col("lcs.d1") + F.col("lcs.d2"))).alias("wup"))


def neighbourhoods(edges: DataFrame, radius: int) -> DataFrame:
    """``centre, v``: all vertices within ``radius`` undirected steps, the centre included."""
    both = edges.select(F.col("child").alias("v"), F.col("parent").alias("to")).unionByName(edges.select(F.col("parent").alias("v"), F.col("child").alias("to"))).distinct()
    near = both.select(F.col("v").alias("centre"), "v").distinct()
    for _ in range(radius):
        near = near.unionByName(near.join(both, "v").select("centre", F.col("to").alias("v"))).distinct()
    return near


def directional_relativity(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """``s1, s2, rel``: the share of the first's neighbourhood that is in the second's, 0 for an empty one."""
    size = near.groupBy(F.col("centre").alias("s1")).agg(F.count("*").alias("n"))
    both = pairs.join(near.select(F.col("centre").alias("s1"), "v"), "s1").join(near.select(F.col("centre").alias("s2"), "v"), ["s2", "v"]).groupBy("s1", "s2").agg(F.count("*").alias("c"))
    return pairs.join(both, ["s1", "s2"], "left").join(size, "s1", "left").select("s1", "s2", F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)).alias("rel"))
