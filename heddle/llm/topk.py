"""Exact top-k by inner product, with candidates eliminated by a pivot table.

A component is added to each vector that gives all the same length; then the nearest vectors are those of largest inner product,
and distances to pivots bound the score of any pair from above. Rows lie in blocks of one pivot's neighbourhood. Each query first
searches its own block, which gives a score that its k best surely reach; other blocks, and their rows, are tried only where
the pivots' bound reaches that score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed_sample, written


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component x, as longs; null if the vector is null or has a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots by farthest point, from a bounded sample of vectors."""
    if not len(sample):
        return sample
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component that gives all the length sqrt(most): then the nearest is the one of largest inner product."""
    return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(1, keepdims=True), 0))])


def upper_bounds(q: np.ndarray, to_pivots: np.ndarray, points: np.ndarray, most: float) -> np.ndarray:
    """Upper bounds of the scores, by query and candidate; ``to_pivots``: the candidates' distances to the lifted ``points``."""
    length = (q * q).sum(1, keepdims=True)
    # queries get no length from the lift: their added component is 0
    own = np.sqrt(np.maximum(length - 2 * q @ points[:, :-1].T + (points**2).sum(1), 0))
    lower = np.zeros((len(q), len(to_pivots)))
    for p in range(len(points)):
        np.maximum(lower, np.abs(own[:, p : p + 1] - to_pivots[:, p]), out=lower)
    return (length + most - lower * lower) / 2 + slack(length, most)


def slack(length, most: float):
    """Covers the rounding of floating-point distances."""
    return 1e-6 * (length + most) + 1


def search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int, step: int = 256) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query: ids and scores of its k best among the candidates, and how many were evaluated.

    Candidates whose bound is under ``least``, a score that k others reach, are eliminated. The others are evaluated in falling order
    of their bounds, until no bound that is left reaches the k-th best score. Equal scores could still win by a smaller
    id, so the search goes on while a bound equals it.
    """
    out = []
    for q in range(len(queries)):
        order = np.flatnonzero((bounds[q] >= least[q]) & (ids != own[q]))
        order = order[np.argsort(-bounds[q][order], kind="stable")]
        kept_ids, kept, done = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for at in range(0, len(order), step):
            if len(kept) >= k and bounds[q][order[at]] < kept[-1]:
                break
            part = order[at : at + step]
            done += len(part)
            kept_ids, kept = np.concatenate([kept_ids, ids[part]]), np.concatenate([kept, (vectors[part] @ queries[q]).astype(np.int64)])
            best = np.lexsort((kept_ids, -kept))[:k]
            kept_ids, kept = kept_ids[best], kept[best]
        out.append((kept_ids, kept, done))
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = 32, sample_rows: int = 4096, block_rows: int = 4096, query_rows: int = 4096, scale: int = 1024, work: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those of the query's own vec_id.
    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part; shorter vectors
    are padded with zeros. Repeated rows each take a rank; a repeated query is searched once for each distinct vector. An empty table
    gives an empty result; other columns are ignored. With ``work``, also evaluated: for how many rows the query's score was computed.

    The pivots are chosen from about ``sample_rows`` rows. Blocks hold about ``block_rows`` rows. In a second pass ``query_rows``
    queries at a time meet the blocks that their distances to the pivots don't rule out; a block is sent once for each such group.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    rows = cut(rows)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    asked = F.col("vec_id") % every == 0
    count, n_asked, most, width = rows.agg(F.count("*"), F.count_if(asked), F.max(norm), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long" + ", evaluated long" * work
    if not n_asked:
        return spark.createDataFrame([], schema)
    most, width = most or 0.0, width or 0
    exact = most < float(1 << 52)  # then floating-point products and their sums are whole numbers without rounding
    kind = np.float64 if exact else np.int64

    def matrix(column) -> np.ndarray:
        out = np.zeros((len(column), width), np.int64)
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return out

    sample = hashed_sample(rows, F.xxhash64("vec_id"), sample_rows).toPandas()
    sample = sample if len(sample) else rows.limit(1).toPandas()
    sample = matrix(sample["v"])[np.lexsort((sample["v"].map(str), sample["vec_id"]))]
    points = choose_pivots(lifted(sample.astype(float), most), pivots)
    homes = min(len(points), max(1, -(-count // block_rows)))  # the first pivots, which lie farthest apart, gather the blocks
    query_homes = min(homes, max(1, -(-n_asked // query_rows)))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = matrix(pdf["v"]).astype(float)
            own = lifted(v, most)
            far = np.sqrt(np.maximum((own**2).sum(1, keepdims=True) - 2 * own @ points.T + (points**2).sum(1), 0))
            bare = np.sqrt(np.maximum((v**2).sum(1, keepdims=True) - 2 * v @ points[:, :-1].T + (points**2).sum(1), 0))
            yield pdf.assign(d=list(far), q=list(bare), length=(v**2).sum(1), home=far[:, :homes].argmin(1).astype(np.int32), query_home=far[:, :query_homes].argmin(1).astype(np.int32))

    table = written(rows.mapInPandas(locate, "vec_id long, v array<long>, d array<double>, q array<double>, length double, home int, query_home int"))

    def numbered(df: DataFrame, home: str, size: int, name: str) -> DataFrame:
        """Blocks of about ``size`` rows around each of the first pivots: at most ``pivots`` counts are collected."""
        parts = {r[0]: -(-r[1] // size) for r in df.groupBy(home).count().collect()}
        many = F.element_at(F.array(*[F.lit(parts.get(i, 1)) for i in range(len(points))]), F.col(home) + 1)
        return df.withColumn(name, F.xxhash64(home, F.pmod(F.xxhash64("vec_id", "v"), many)))

    table = numbered(table, "home", block_rows, "block")
    queries = numbered(table.where(asked).dropDuplicates(["vec_id", "v"]), "query_home", query_rows, "part")

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x, to_pivots = right["vec_id"].to_numpy(), matrix(right["v"]).astype(kind), np.stack(right["d"].to_numpy())
            for at in range(0, len(left), 64):
                some = left.iloc[at : at + 64]
                q = matrix(some["v"])
                bounds = upper_bounds(q.astype(float), to_pivots, points, most)
                for own, v, (got, scores, done) in zip(some["vec_id"], some["key"], search(q.astype(kind), some["vec_id"].to_numpy(), some["least"].to_numpy(), ids, x, bounds, k), strict=True):
                    out.append(pd.DataFrame({"query_id": own, "key": v, "vec_id": [*got, -1], "score": [*scores, 0], "evaluated": [*[0] * len(got), done], "hit": [*[True] * len(got), False]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "key": [], "vec_id": [], "score": [], "evaluated": [], "hit": []}).astype({"query_id": "int64", "key": "int64", "vec_id": "int64", "score": "int64", "evaluated": "int64", "hit": "bool"})

    result = "query_id long, key long, vec_id long, score long, evaluated long, hit boolean"
    queries = queries.withColumn("key", F.xxhash64("v"))
    right = table.select("block", "vec_id", "v", "d")
    first = written(queries.select("block", "vec_id", "v", "key", F.lit(float("-inf")).alias("least")).groupBy("block").cogroup(right.groupBy("block")).applyInPandas(found, result))
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    reached = first.where("hit").withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), "key", F.col("score").cast("double").alias("least"))
    queries = written(queries.join(reached, ["vec_id", "key"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).withColumnRenamed("block", "own_block"))

    ends = lambda c, df, by: df.groupBy(by).agg(*[f(F.get(c, F.lit(p))).alias(f"{c}_{name}{p}") for p in range(len(points)) for f, name in ((F.min, "low"), (F.max, "high"))], *([F.min("least").alias("least"), F.max("length").alias("length"), F.min("own_block").alias("only_low"), F.max("own_block").alias("only_high")] if by == "part" else []))
    blocks, parts = ends("d", right, "block"), ends("q", queries, "part")
    gap = F.greatest(F.lit(0.0), *[g for p in range(len(points)) for g in (F.col(f"q_low{p}") - F.col(f"d_high{p}"), F.col(f"d_low{p}") - F.col(f"q_high{p}"))])
    within = (F.col("length") + most - gap * gap) / 2 + slack(F.col("length"), most) >= F.col("least")
    # a stated query set against all rows, group by block: what meets here are groups and blocks, not rows
    cells = cut(parts.join(blocks, within & ~((F.col("only_low") == F.col("block")) & (F.col("only_high") == F.col("block")))).select("part", "block"))
    left = queries.join(cells, "part").where("own_block != block").select("part", "block", "vec_id", "v", "key", "least")
    rest = left.groupBy("part", "block").cogroup(right.join(cells, "block").groupBy("part", "block")).applyInPandas(found, result)
    both = first.unionByName(rest)
    best = both.where("hit").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # repeated queries have had one search for each distinct vector; their ranks are those of the merged rows
    again = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)
    if work:
        best = best.drop("evaluated").join(both.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated")), "query_id")
    return best.select("query_id", "rank", "vec_id", "score", *["evaluated"] * work)
