"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running

#: Multiplier of the 64-bit linear congruential generator of the published algorithm.
MULTIPLIER = 2862933555777941757
MASK = (1 << 32) - 1


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One generator step, ``key * MULTIPLIER + 1`` modulo 2**64, on 32-bit halves: no product leaves 63 bits."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & MASK
    a, b = m_lo >> 16, m_lo & 0xFFFF
    low = lo * b + F.shiftleft((lo * a).bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(lo * a, 16)
    high = carry + hi * b + F.shiftleft((hi * a).bitwiseAND(F.lit(0xFFFF)), 16) + lo * m_hi
    return high.bitwiseAND(F.lit(MASK)), low.bitwiseAND(F.lit(MASK))


def _jump(acc: Column, limit: int) -> Column:
    hi, lo = _next(acc["hi"], acc["lo"])
    step = F.struct(acc["b"].alias("before"), acc["j"].alias("b"), acc["j"].alias("j"), hi.alias("hi"), lo.alias("lo"))
    to = F.floor((step["b"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(step["hi"], 1) + 1).cast("double")))
    moved = F.struct(acc["b"].alias("before"), acc["j"].alias("b"), to.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
    return F.when(acc["j"] < limit, moved).otherwise(acc)


def jump_hash(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a 64-bit key among ``shards``, and among one more.

    The jumps of a key rise strictly, so those below ``shards`` are also the path of any smaller count: both answers come
    from one walk. Up to 64 jumps are walked; the rare rest goes on, up to ``shards`` + 1 jumps, so the answer is exact.
    """
    key, zero, limit = F.coalesce(key, F.lit(0)).cast("long"), F.lit(0).cast("long"), shards + 1
    start = F.struct((zero - 1).alias("before"), (zero - 1).alias("b"), zero.alias("j"), F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"))

    def result(acc: Column) -> Column:
        return F.struct(F.when(acc["b"] == shards, acc["before"]).otherwise(acc["b"]).cast("int").alias("shard"), acc["b"].cast("int").alias("grown"))

    if limit <= 64:
        return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, lambda acc, _: _jump(acc, limit), result)
    first = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda acc, _: _jump(acc, limit))
    rest = F.transform(F.array(first), lambda s: F.when(s["j"] < limit, F.aggregate(F.sequence(F.lit(1), F.lit(limit)), s, lambda acc, _: _jump(acc, limit))).otherwise(s))
    return F.element_at(F.transform(rest, result), 1)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only doc_id and ``shards`` decide the shard (law ``key``); with one more shard, rows move into the new one only.
    A null doc_id counts as key 0, a null text as empty (size 1, checksum 0). Slots run from 0 without gaps in each shard:
    rows are numbered within 4096 hashed blocks a shard, and the blocks' counts give the offsets, so a shard is never
    in one task. Rows repeated in full get different slots. Columns other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_j", jump_hash(F.col("doc_id"), shards)).select("*", F.lit("key").alias("law"), F.col("_j.shard").alias("shard"), F.col("_j.grown").alias("grown_shard")).drop("_j")
    rows = rows.withColumn("_block", F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")).cast("binary")), 1, 3), 16, 10).cast("int"))
    slots = running(rows, "shard", "_block", ["doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "slot", most=shards * 4096)
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
