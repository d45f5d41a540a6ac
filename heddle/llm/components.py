"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: Edges that one task can hold.
PLAIN = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b) reaches; a != b, in any order, repeats allowed.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest, by a minimum and a join back. The minimum
    is combined before the shuffle, and the join back broadcasts the few nodes of very many edges, so none is gathered
    in one task. Rounds grow with the logarithm of the longest path. No edges give no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    last, count = None, e.count()
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = spread_join(both.where("v > u"), least, "u", "_n", 2 * count, PLAIN).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        moved = spread_join(large, low, "a", "_n", large.count(), PLAIN).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        e = cut(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == last or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last, count = now, now[0]
