"""Connected components of an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node is busy from this share of all edges on, so at most so many nodes are. Up to ``PLAIN`` rows, which one task can hold, none is.
BUSY, PLAIN = 2000, 200_000


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut, in the folder that spark.checkpoint.dir names; a temporary one serves runs in one process only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def joined(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts`` (key, m, k: how many of the ``total`` rows have it): facts of the few busy keys are broadcast, so that no task
    gets all rows of one."""
    if total <= PLAIN:
        return rows.join(facts.select(key, "m"), key)
    busy = F.col("k") * BUSY > F.lit(total)
    many = F.broadcast(facts.where(busy).select(key, F.col("m").alias("_b")))
    marked = rows.join(many, key, "left")
    few = marked.where("_b is null").drop("_b").join(facts.where(~busy).select(key, "m"), key)
    return marked.where("_b is not null").withColumnRenamed("_b", "m").unionByName(few)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reached), for every node of the edges a, b, by alternating large and small stars.

    A node's larger neighbours, then its smaller ones, are hung on the smallest until nothing moves. Minima are joined back, so
    no node's neighbours are gathered.
    """
    e = cut(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").where("a != b").distinct())
    last, n = None, e.count()
    while True:
        both = e.selectExpr("a as u", "b as v").unionByName(e.selectExpr("b as u", "a as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).selectExpr("u", "least(u, m) as m", "k")
        large = cut(joined(both.where("v > u"), least, "u", 2 * n).selectExpr("v as a", "m as b").where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        moved = joined(large, low, "a", large.count()).selectExpr("b as a", "m as b").where("a != b")
        e = cut(moved.unionByName(low.selectExpr("a", "m as b")).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == last or not now[0]:
            return e.selectExpr("a as node", "b as root").unionByName(e.selectExpr("b as node", "b as root").distinct())
        last, n = now, now[0]
