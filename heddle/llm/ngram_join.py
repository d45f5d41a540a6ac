"""Similarity self-join of documents on their word n-grams, by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. A size class cuts that order into F equal fragments. Two sets
as similar as asked differ in at most D n-grams; if one of them has n-grams in more than D fragments, it agrees entirely with
the other in at least one of those. So candidates are sets with an equal fragment, which makes a passage that many documents
share harmless: it fills few fragments on its own. Candidates are then counted fragment by fragment, and the partial overlaps
summed per pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_columns
from .common import cut, done, fresh, salted_join, small, spread_join, written
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
REMEMBERED = 120_000
#: Fragments in which overlaps are counted.
PARTS = 4
#: Pairs of one set that a task compares, about.
EACH = 4096
#: Ratio of the bounds of size classes.
CLASS_RATIO = 1.4


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit moves each output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of the n-word shingles of texts, A-Z lower-cased; shorter texts are one shingle, wordless ones none."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.n, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i]
        return np.unique(mixed(h))


@functools.lru_cache(None)
def class_bounds(index: int) -> int:
    """Smallest set size of a class."""
    return 1 if index == 0 else max(class_bounds(index - 1) + 1, math.ceil(class_bounds(index - 1) * CLASS_RATIO))


def class_of(size: int) -> int:
    index = 0
    while class_bounds(index + 1) <= size:
        index += 1
    return index


def allowed(a: int, b: int, num: int, den: int) -> int:
    """How many n-grams two linked sets of these sizes can differ in, at most."""
    return (a + b) * (den - num) // (den + num)


@functools.lru_cache(None)
def fragments(index: int, num: int, den: int) -> tuple[int, int]:
    """(F, largest set) of a class: enough fragments that sets of all its sizes are expected to fill more than they can differ in."""
    most = (class_bounds(index + 1) - 1) * den // num
    f = 1
    while True:
        if all(f * (1 - (1 - 1 / f) ** s) >= 1.06 * allowed(s, min(most, s * den // num), num, den) + 1 for s in {class_bounds(index), (class_bounds(index) + most) // 2, most}):
            return f, most
        f += max(1, f // 50)


def signatures(h: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """Hashes of a set's fragments, for its own class and, if a linked set can be in the class below, for that too; and by the
    parity of the class, which the lowest bit of its hashes shows, one more than the fragments that can differ less those filled.

    Classes belong to the smaller set of a pair. A set that fills no more fragments than it can differ in also signs its empty
    ones: two such sets that agree only there still meet. A set linked to it may sign none, so no empty one counts as shared.
    """
    out, size, spare = [], len(h), [0, 0]
    own = class_of(size)
    for index in {own, own - 1} if own and -(-size * num // den) < class_bounds(own) else {own}:
        f, most = fragments(index, num, den)
        place = ((h >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        filled = place[first]
        sums = np.add.reduceat(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        tag = np.uint64((index + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        found = [mixed(sums + mixed(filled + tag))]
        can_differ = allowed(size, min(most, size * den // num), num, den)
        if len(filled) <= can_differ:
            empty = np.setdiff1d(np.arange(f, dtype=np.uint64), filled)
            found.append(mixed(mixed(empty + tag) + np.uint64(1)))
        found = np.concatenate(found)
        out.append(found & ~np.uint64(1) | np.uint64(index & 1))
        spare[index & 1] = can_differ + 1 - len(filled)
    return np.concatenate(out), spare


def set_id(h: np.ndarray) -> int:
    """64-bit hash of a whole set; equal for equal sets."""
    return int(mixed(np.array([np.add.reduce(mixed(h + np.uint64(0x632BE59BD9B4E019)))], np.uint64) + np.uint64(len(h))).view(np.int64)[0])


def signed_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, key, n_shingles, set_id (null for the empty set), signatures (none where the task has had an equal set before), spare_0, spare_1."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType()), T.StructField("signatures", T.ArrayType(T.LongType())), T.StructField("spare_0", T.IntegerType()), T.StructField("spare_1", T.IntegerType())]

    def make():
        shingler, seen = Shingler(n), set()

        def one(text: str) -> tuple:
            h = shingler(text)
            if not len(h):
                return 0, None, [], None, None
            key = set_id(h)
            if key in seen:
                return len(h), key, [], None, None
            if len(seen) < 4 * REMEMBERED:
                seen.add(key)
            signed, spare = signatures(h, num, den)
            return len(h), key, signed.view(np.int64), *spare

        return lambda texts: list(zip(*map(one, texts), strict=True))

    return with_columns(docs, "text", fields, make, ["doc_id", "key"])


def bucket_members(signed: DataFrame) -> DataFrame:
    """bucket, first, set_id: the sets of each signature that two different sets share, beside the smallest of them."""
    rows = signed.where("set_id is not null").select(F.explode("signatures").alias("bucket"), "set_id").repartition("bucket").sortWithinPartitions("bucket", "set_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, s = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            before_b = np.concatenate([[b[0] if bucket is None else bucket], b[:-1]])
            before_s = np.concatenate([[s[0] if last is None else last], s[:-1]])
            new = b != before_b
            if bucket is None:
                new[0] = True
            start = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
            firsts = np.where(start < 0, s[0] if first is None else first, s[start])
            other = ~new & (s != before_s)
            opened = other & (before_s == firsts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([b[other], b[opened]])), pa.array(np.concatenate([firsts[other], firsts[opened]])), pa.array(np.concatenate([s[other], firsts[opened]]))], names=["bucket", "first", "set_id"])
            bucket, first, last = b[-1], firsts[-1], s[-1]

    return rows.mapInArrow(runs, "bucket long, first long, set_id long")


def rarest(members: DataFrame, spare: DataFrame) -> DataFrame:
    """``members`` in each set's rarest buckets only, as many as any link must still meet in.

    Linked sets agree in all but D of a set's m filled fragments, so they share m - D buckets; of two lists that share so many, in
    one common order, the first D + 1 of each already meet, or D + 1 and as many as there are empty ones where a set signs those.
    The order is by size: buckets of one set come first and need no row.
    """
    members = members.select("bucket", "set_id")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("_n"))
    mine = Window.partitionBy("set_id", "_class")
    rows = members.join(sizes, "bucket").withColumn("_class", F.col("bucket").bitwiseAND(F.lit(1))).join(spare, "set_id")
    rows = rows.withColumn("_rank", F.row_number().over(mine.orderBy("_n", "bucket"))).withColumn("_keep", F.count("*").over(mine) + F.when(F.col("_class") == 0, F.col("spare_0")).otherwise(F.col("spare_1")))
    rows = cut(rows.where("_rank <= _keep").select("bucket", "set_id"))
    firsts = rows.groupBy("bucket").agg(F.min("set_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(firsts, "bucket").select("bucket", "first", "set_id")


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """set_id, size, p0, rest: the hashes of the wanted sets, cut into ``PARTS`` parts of the global order; p0 is the first part."""
    fields = [T.StructField("found", T.LongType()), T.StructField("size", T.LongType()), T.StructField("p0", T.ArrayType(T.LongType())), T.StructField("rest", T.ArrayType(T.ArrayType(T.LongType())))]
    ends = np.array([(1 << 64) // PARTS * (i + 1) - 1 for i in range(PARTS - 1)], dtype=np.uint64)

    def make():
        shingler = Shingler(n)

        def one(text: str) -> tuple:
            h = shingler(text)
            parts = np.split(h.view(np.int64), np.searchsorted(h, ends, side="right"))
            return (set_id(h) if len(h) else None), len(h), parts[0], parts[1:]

        return lambda texts: list(zip(*map(one, texts), strict=True))

    rows = with_columns(docs.select("doc_id", "text").join(small(wanted, 500_000, ready=True), "doc_id"), "text", fields, make, ["set_id"])
    return rows.where("found = set_id").drop("found").dropDuplicates(["set_id"])


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the candidate pairs (a, b) that reach the similarity: overlaps are counted in each part and summed per pair.

    The first part alone rules out most: where two sets differ by more there than they may in all, the rest isn't fetched.
    """
    left, right = [sets.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "p0")]) for x in ("a", "b")]
    common: Column = F.size(F.array_intersect("p0_a", "p0_b"))
    low, high = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    room = F.floor((F.col("size_a") + F.col("size_b")) * (den - num) / F.lit(den + num)) + 1  # one over, against rounding
    total = pairs.count()
    met = salted_join(salted_join(pairs, left, "a", F.xxhash64("b"), EACH, total), right, "b", F.xxhash64("a"), EACH, total)
    near = met.where((den * low >= num * high) & (F.size("p0_a") + F.size("p0_b") - 2 * common <= room))
    near = near.select("a", "b", F.col("size_a").alias("x"), F.col("size_b").alias("y"), common.alias("o"))
    rest_a, rest_b = [sets.select(F.col("set_id").alias(x), F.col("rest").alias(f"rest_{x}")) for x in ("a", "b")]
    near = cut(near)
    total = near.count()
    both = salted_join(salted_join(near, rest_a, "a", F.xxhash64("b"), EACH, total), rest_b, "b", F.xxhash64("a"), EACH, total)
    partial = F.zip_with("rest_a", "rest_b", lambda p, q: F.size(F.array_intersect(p, q)))
    overlap = F.col("o") + F.aggregate(partial, F.lit(0), lambda s, p: s + p)
    return both.withColumn("o", overlap).where(den * F.col("o") >= num * (F.col("x") + F.col("y") - F.col("o"))).select("a", "b")


def rest_of_buckets(members: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int, most: int = 1024, cluster: int = 8192) -> DataFrame:
    """Links between the sets of a bucket that neither share a component yet nor were tested against the bucket's first.

    Sets that meet in many buckets would be sent for each: so buckets that hang together count as one, as long as they hold
    at most ``cluster`` sets; larger clusters are left as their buckets. The sets outside the bucket's commonest component meet all of its sets, in cells of at most ``most`` by ``most`` sets, fewer
    if the sets are large. A cell counts overlaps part by part, sums them, and returns a spanning forest of its links.
    """
    known = members.where("set_id != first").select("bucket", "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    known = known.select("bucket", "set_id", F.coalesce("root", "set_id").alias("comp"))
    open_ = known.groupBy("bucket").agg(F.min("comp").alias("_a"), F.max("comp").alias("_z")).where("_a != _z").select("bucket")
    known = cut(known.join(open_, "bucket").join(sets.select("set_id", "size"), "set_id"))
    firsts = known.groupBy("bucket").agg(F.min("set_id").alias("a"))
    roots = components(known.join(firsts, "bucket").select("a", F.col("set_id").alias("b")))
    sizes = roots.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") <= cluster)
    kept = roots.join(sizes, "root").select(F.col("node").alias("set_id"), F.col("root").alias("_root"))
    known = known.join(kept, "set_id", "left").withColumn("bucket", F.when(F.col("_root").isNull(), F.xxhash64(F.lit("bucket"), "bucket")).otherwise(F.xxhash64(F.lit("cluster"), "_root")))
    known = cut(known.select("bucket", "set_id", "comp", "size").distinct())
    counts = known.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    tops = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.max("size").alias("size"))
    room = F.greatest(F.lit(16), F.least(F.lit(most), F.floor(F.lit(1 << 21) / F.col("size")))).cast("int")
    tops = tops.select("bucket", "main", F.ceil((F.col("n") - F.col("n_main")) / room).cast("int").alias("n_i"), F.ceil(F.col("n") / room).cast("int").alias("n_j"))
    rows = known.join(tops, "bucket")
    h = F.xxhash64("set_id", "bucket")
    left = rows.where("comp != main").select("bucket", F.pmod(h, F.col("n_i")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)).alias("j"), "set_id", "comp", F.lit(True).alias("left"))
    right = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)).alias("i"), F.pmod(h, F.col("n_j")).cast("int").alias("j"), "set_id", "comp", F.lit(False).alias("left"))
    cells = left.unionByName(right).join(sets.select("set_id", "size", F.concat(F.array("p0"), "rest").alias("parts")), "set_id")

    def meet(cell: pd.DataFrame) -> pd.DataFrame:
        a, b = cell[cell["left"]], cell[~cell["left"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        overlap = np.zeros((len(a), len(b)), np.float32)
        for part in range(PARTS):
            own = [[np.asarray(x[part], np.int64) for x in side["parts"]] for side in (a, b)]
            flat = [np.concatenate(x) for x in own]
            shared = np.intersect1d(flat[0], flat[1])
            for at in range(0, len(shared), 2048):
                some = shared[at : at + 2048]
                grids = []
                for arrays, values in zip(own, flat, strict=True):
                    column = np.searchsorted(some, values).clip(max=len(some) - 1)
                    hit = some[column] == values
                    grid = np.zeros((len(arrays), len(some)), np.float32)
                    grid[np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])[hit], column[hit]] = 1
                    grids.append(grid)
                overlap += grids[0] @ grids[1].T
        total = a["size"].to_numpy()[:, None] + b["size"].to_numpy()[None, :]
        o = overlap.astype(np.int64)
        fits = (den * o >= num * (total - o)) & (a["comp"].to_numpy()[:, None] != b["comp"].to_numpy()[None, :])
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        ids_a, ids_b, comp_a, comp_b, found = a["set_id"].to_numpy(), b["set_id"].to_numpy(), a["comp"].to_numpy(), b["comp"].to_numpy(), []
        for i, j in zip(*np.nonzero(fits), strict=True):
            p, q = top(int(comp_a[i])), top(int(comp_b[j]))
            if p != q:
                parent[p] = q
                found.append((ids_a[i], ids_b[j]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return cells.groupBy("bucket", "i", "j").applyInPandas(meet, "a long, b long")


def classes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, set_id, component_id, component_key for every document; see ``join``.

    component_id and component_key belong to the document of smallest doc_id, then key, that links reach.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    signed = written(signed_sets(docs, n, num, den))
    grouped = signed.where("set_id is not null and doc_id is not null").groupBy("set_id")
    sets = cut(grouped.agg(F.min(F.struct("doc_id", "key")).alias("first"), F.max("spare_0").alias("spare_0"), F.max("spare_1").alias("spare_1"), F.count("*").alias("n_docs")))
    shared = written(bucket_members(signed.where("doc_id is not null")))
    members = written(rarest(shared, sets.select("set_id", "spare_0", "spare_1")))
    done(shared)
    wanted = cut(members.select("set_id").distinct().join(sets.select("set_id", "first.doc_id"), "set_id"))
    hashes = written(shingle_sets(docs, wanted, n))
    pairs = members.where("set_id != first").select(F.col("first").alias("a"), F.col("set_id").alias("b")).distinct()
    links = cut(linked(pairs, hashes, num, den))
    labels = components(links)
    more = cut(rest_of_buckets(members, labels, hashes, num, den))
    done(members, hashes)
    if more.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = sets.select("set_id", "first", "n_docs").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = cut(named.withColumn("root", F.coalesce("root", "set_id")))
    smallest = named.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("_n"))
    facts = spread_join(named.select("set_id", "n_docs", "root"), smallest, "root", "_n", named.count())
    facts = cut(facts.select("set_id", "n_docs", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("component_key")))
    rows = signed.select("doc_id", "key", "n_shingles", "set_id")
    full = spread_join(rows.where("set_id is not null and doc_id is not null"), facts, "set_id", "n_docs", signed.count())
    alone = rows.where("set_id is null or doc_id is null").withColumns({"component_id": F.when(F.col("set_id").isNull(), F.col("doc_id")), "component_key": F.col("key")})
    return full.unionByName(alone)


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every document: the smallest doc_id that links reach, itself included.

    Documents link when their sets of distinct ``n``-word shingles share num/den of their union or more. Texts of fewer words
    are one shingle; null and wordless texts are empty and link with nothing. Copies (equal sets) link by their equal set hash
    and enter the join once. Rows without doc_id link with nothing and have no component. Repeated rows stay. An empty table
    gives an empty result; columns other than doc_id and text are ignored. Exact up to collisions of 64-bit hashes.
    """
    return classes(docs, n, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group of linked documents the one of smallest doc_id stays.

    Where that doc_id has several linked texts, the one of smallest text hash stays; texts of a doc_id that aren't linked are judged
    apart. A row repeated in doc_id and text stays once. Rows without doc_id, and wordless ones, are in no group and stay, an empty
    table stays empty, and all columns are returned as they are, whatever their names.
    """
    found = cut(classes(docs, n, num, den).where("doc_id is not null and set_id is not null"))
    own = i, k = fresh(docs, "_id", "_key")
    stays = (F.col("component_id") == F.col("doc_id")) & (F.col("component_key") == F.col("key"))
    named = lambda df: df.select(F.col("doc_id").alias(i), F.col("key").alias(k))
    gone = small(named(found.where(~stays)).distinct(), 500_000)
    again = cut(named(found.where(stays).groupBy("doc_id", "key").count().where("count > 1")))
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), k: F.xxhash64("text")}).join(gone, own, "left_anti")
    if not again.limit(1).count():
        return rows.select(docs.columns)
    again = small(again, 500_000, ready=True)
    once = rows.join(again, own, "left_semi").dropDuplicates(own)
    return rows.join(again, own, "left_anti").unionByName(once).select(docs.columns)
