"""Preference formatting of chosen and rejected conversations, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_neighbours(turns: DataFrame) -> DataFrame:
    """Marks conversation 2k as chosen and 2k + 1 as rejected of pair k. Turns without a conv_id are in no pair and go."""
    rows = turns.where(F.col("conv_id").isNotNull())
    return rows.select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), (F.pmod(F.col("conv_id"), F.lit(2)) == 0).alias("chosen"), "conv_id", "turn", "role", "text")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column, offset: Column) -> Column:
    """Character spans that carry the loss, as from-to pairs in prompt plus completion: the text and end mark of assistant turns."""
    start = F.struct(offset.cast("long").alias("at"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.length(turn["role"]) + 5
        end = begin + F.length(turn["text"]) + 7
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["found"], ";"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row a pair: the longest common prefix of turns rendered once as the prompt, and both completions with loss masks.

    ``turns`` has pair_id, chosen, turn, role, text. Turns go by turn number, then role, then text; a repeated turn counts as
    often as it stands, a null role or text is empty, and null turn numbers come first. A conversation that is a prefix of the
    other gets an empty completion. A pair with one side only has an empty prompt and a null other side. Rows without pair_id form
    a pair of their own; an empty table gives an empty result; other columns are ignored, whatever their names. Both conversations of a
    pair meet in one row, so a pair of conversations is what a task must hold; texts are never cut.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("chosen") == want, turn))).alias(name) for name, want in (("_c", True), ("_r", False))])
    plain = lambda x: F.transform(x, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sides = sides.select("pair_id", plain(F.col("_c")).alias("_c"), plain(F.col("_r")).alias("_r"))
    shorter = F.least(F.size("_c"), F.size("_r"))
    differs = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: F.get("_c", i) != F.get("_r", i))
    common = F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)), shorter))
    sides = sides.withColumn("n_common", common.cast("int")).withColumn("prompt", _joined(F.slice("_c", F.lit(1), F.col("n_common"))))
    out = ["pair_id", "n_common", "prompt"]
    for name, side in (("chosen", "_c"), ("rejected", "_r")):
        rest = F.slice(side, F.col("n_common") + 1, F.size(side))
        there = F.size(side) > 0
        sides = sides.withColumn(f"n_{name}", F.size(side)).withColumn(name, F.when(there, _joined(rest))).withColumn(f"{name}_mask", F.when(there, _spans(rest, F.length("prompt"))))
        out += [f"n_{name}", name, f"{name}_mask"]
    return sides.select(*out)
