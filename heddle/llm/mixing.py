"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, running, small, words


def bit_reversal(value: Column, bits: int) -> Column:
    """``value`` with its lowest ``bits`` bits reversed: the van der Corput point of ``value``, times 2**bits."""
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        value = F.shiftleft(value.bitwiseAND(F.lit(mask)), width).bitwiseOR(F.shiftrightunsigned(value, width).bitwiseAND(F.lit(mask)))
    value = F.shiftleft(value, 32).bitwiseOR(F.shiftrightunsigned(value, 32))
    return F.shiftrightunsigned(value, 64 - bits) if bits else F.lit(0).cast("long")


def targets(sources: DataFrame, times: int = 3) -> DataFrame:
    """source_key, source_size -> also weight, target.

    Sources weigh 1, 2, 3, repeating, in the order of their keys and share the sum of all sizes. A target stops at ``times``
    its source's size; what is over goes to the others by weight. That water level is found in one pass: sorted by cap per
    weight, the first source whose cap is not below the level of those that remain ends the capped ones.
    The table has one row a source, so its windows over all sources hold as many rows as there are sources.
    """
    ranked = sources.withColumn("weight", (F.row_number().over(Window.orderBy("source_key")) - 1) % 3 + 1)
    ranked = ranked.withColumn("_cap", F.col("source_size") * times)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "source_key")
    prior = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(prior), F.lit(0))).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(prior), F.lit(0))).cast("double"))
    ranked = ranked.withColumn("_open", F.col("_level") * F.col("weight") <= F.col("_cap"))
    level = F.coalesce(F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    return ranked.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("weight"))).select("source_key", "source_size", "weight", "target")


def streams(docs: DataFrame, seed: int = 11) -> DataFrame:
    """One row a document: doc_id, key (hash of id and text), source_key, size, source_size, target, and ``start``: its place in its source's shuffled stream of words.

    The source key is the source's name behind an ``s``, or ``~`` (sorted last) for null. Documents are shuffled by a digest of
    their id and text; repeated rows are interchangeable. Null texts have size 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    base = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")).alias("source_key"), F.xxhash64("doc_id", "text").alias("key"), F.size(words(F.col("text"))).cast("long").alias("size"), digest.alias("_h"))
    base = cut(base.withColumn("_block", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")))
    aims = cut(targets(base.groupBy("source_key").agg(F.sum("size").alias("source_size"))))
    return running(base, "source_key", "_block", ["_h"], F.col("size"), "start").join(small(aims, 100_000), "source_key")


def schedule(aims: DataFrame, block_words: int, chunk: int = 1 << 16) -> DataFrame:
    """slot, source_key, rank: which source fills each slot of the mix, and which of its blocks.

    A source needs ceil(target / block_words) slots. Laid end to end, these needs are the cumulative weights, and the van der
    Corput point of a slot falls into the interval of its source: the slots of any stretch split as the weights do. As
    the points are a permutation of whole numbers, each source gets exactly its slots; a slot's rank is its place among them.
    """
    needs = aims.withColumn("_n", F.ceil(F.floor("target") / F.lit(float(block_words))).cast("long")).where("_n > 0")
    needs = cut(needs.withColumn("_from", F.sum("_n").over(Window.orderBy("source_key")) - F.col("_n")).select("source_key", "_n", "_from"))
    total = needs.agg(F.sum("_n")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(total))) if total > 1 else 0
    parts = needs.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk)))).repartition("source_key", "_c")
    points = parts.withColumn("_p", F.explode(F.sequence(F.col("_c") * chunk, F.least(F.col("_n"), (F.col("_c") + 1) * chunk) - 1)))
    points = points.select("source_key", bit_reversal(F.col("_from") + F.col("_p"), bits).alias("slot"))
    points = points.withColumn("_block", F.shiftright("slot", 16))
    return running(points, "source_key", "_block", ["slot"], F.lit(1).cast("long"), "rank").select("slot", "source_key", "rank")


def mix(docs: DataFrame, block_words: int = 1024, times: int = 3, seed: int = 11, placed: DataFrame | None = None) -> DataFrame:
    """slot, doc_id, source_key, start, reading, first_word, n_words: the mix, as stretches of documents in the order of the slots.

    ``reading`` is 0 for the first time that a document is read. A source's shuffled documents form one stream of words, read again from the start up to ``times`` times; block ``rank`` is its
    words from rank * block_words on, and the last block ends at the target. Only joins by (source, block) are made, so a
    source that holds most rows spreads over all tasks. Documents without words are in no block.
    """
    placed = placed if placed is not None else cut(streams(docs, seed))
    slots = schedule(placed.select("source_key", "source_size", "target").distinct(), block_words)
    turns = placed.where("size > 0").withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    begin = F.col("_e") * F.col("source_size") + F.col("start")
    turns = turns.withColumn("_a", begin).withColumn("_z", F.least(begin + F.col("size"), F.floor("target").cast("long"))).where("_a < _z")
    width = F.lit(block_words).cast("long")
    pieces = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor((F.col("_z") - 1) / width))))
    low, high = F.greatest("_a", F.col("rank") * width), F.least("_z", (F.col("rank") + 1) * width)
    pieces = pieces.select("source_key", "rank", "doc_id", "start", "size", F.col("_e").alias("reading"), (low - F.col("_a")).alias("first_word"), (high - low).alias("n_words"))
    return slots.join(pieces, ["source_key", "rank"]).select("slot", "doc_id", "source_key", "start", "size", "reading", "first_word", "n_words")


def taken(docs: DataFrame, block_words: int = 1024, times: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, key, size, source_size, target, taken, first_slot, slots, source: how many of a document's words the mix takes, repeats
    counted, the first slot that holds some of them, and that of each reading; null where there is none.

    Null sources are a source; null and wordless texts have size 0 and are never taken. An empty table gives an empty result.
    """
    placed = cut(streams(docs, seed))
    parts = mix(docs, block_words, times, seed, placed).groupBy("source_key", "start")
    slot = lambda e: F.min(F.when(F.col("reading") == e, F.col("slot")))
    sums = parts.agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.array(*[slot(e) for e in range(times)]).alias("slots"))
    full = placed.where("size > 0").join(sums, ["source_key", "start"], "left")
    rows = full.unionByName(placed.where("size = 0"), allowMissingColumns=True)
    return rows.select("doc_id", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot", "slots", F.when(F.col("source_key") != "~", F.substring("source_key", 2, 1 << 30)).alias("source"))


def apply_mix(docs: DataFrame, block_words: int = 1024, times: int = 3, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, in the order of its slots: whole documents, as often as it reads them, begun readings
    counted.

    A document that the mix doesn't reach, or without words, goes; none stands more than ``times`` times. Repeated rows share
    what they are taken together. Rows are laid out by ranges of slots and sorted within, so a prefix of the result is a prefix of
    the mix. All columns are returned as they are, whatever their names; an empty table stays empty.
    """
    key, copies, slots, slot = fresh(docs, "_key", "_copies", "_slots", "_slot")
    by_key = taken(docs, block_words, times, seed).groupBy(F.col("key").alias(key))
    sums = by_key.agg(F.ceil(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias(copies), F.array(*[F.min(F.get("slots", F.lit(e))) for e in range(times)]).alias(slots)).where(F.col(copies) > 0)
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(small(sums, 200_000), key)
    chosen = F.transform(F.sequence(F.lit(0), F.col(copies) - 1), lambda e: F.coalesce(F.get(F.col(slots), e), F.get(F.col(slots), F.lit(0))))
    rows = rows.withColumn(slot, F.explode(chosen))
    return rows.repartitionByRange(F.col(slot)).sortWithinPartitions(slot).select(docs.columns)
