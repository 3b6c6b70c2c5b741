"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def connected_components(links: DataFrame, store: Store, name: str = "components") -> DataFrame:
    """``id, class``: every id in ``links (a, b)`` with the smallest id it is linked to.

    A round sends each edge on to the smallest neighbour of its ends; minima are taken in each task
    before the shuffle, so an id of many links costs a row per task. Rounds number the logarithm of the
    longest chain.
    """
    edges = store.put(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    seen, step = None, 0
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if not mark.n:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("class"))
        if seen == tuple(mark):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("class")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())
        seen, step = tuple(mark), step + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store.put(large.where("a <> b").distinct(), f"{name}_{step}_large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = store.put(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), f"{name}_{step}")
        store.drop(f"{name}_{step}_large")
        store.drop(f"{name}_{step - 1}")
