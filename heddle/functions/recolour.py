"""Recolour messages and colour plans as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import colour, layers
from .text import bound, lookup_colour

# Words of the messages.
CLOTH = ["kapda", "kapde", "kapra", "kapre", "kapdaa", "cloth", "fabric"]
JOINING = ["aur", "and", "phir", "&", ",", ";", "\n"]
BEFORE_NUMBER = ["ink", "rang", "colour", "color", "no", "number"]
AFTER_NUMBER = [")", ".", "=", ":", "-", "->", "→", "wala", "wali", "ko", "ka", "ki"]
BECOMES = ["ko", "to", "se", "->", "=>", "→"]
INSTEAD = ["ki", "ke"]
#: How far (CIE76) the colour that a message names may be from an ink of the design.
NEAR_INK = 45.0

#: Tokens: a colour code, an arrow, a number, a word, a line end, any other mark.
TOKEN = r"#?\b[0-9a-f]{6}\b|->|=>|\d+|[a-z]+(?:-[a-z]+)?|\n|[^\s\da-z]"


def clauses(messages: DataFrame) -> DataFrame:
    """id, place, words: the token lists of a message's clauses, which commas, semicolons, line ends and joining words part."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0))
    opened = F.array(F.array().cast("array<string>"))
    last = lambda lists: F.element_at(lists, -1)
    add = lambda lists, t: F.when(t.isin(JOINING), F.concat(lists, opened)).otherwise(F.concat(F.slice(lists, F.lit(1), F.size(lists) - 1), F.array(F.array_append(last(lists), t))))
    return messages.select("id", F.posexplode(F.aggregate(tokens, opened, add)).alias("place", "words")).where(F.size("words") > 0)


def read_clause(w: Column) -> Column:
    """struct(kind, number, old, new) of a clause: ``cloth`` and ``ink`` name a new colour, ``swap`` the old one too."""
    said = lambda words: lookup_colour(F.array_join(words, " "))
    tail = lambda n: F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0)))
    lead = F.when(~F.coalesce(F.get(w, F.lit(0)).isin(BEFORE_NUMBER), F.lit(False)), 0).when(F.get(w, F.lit(1)) == ".", 2).otherwise(1)
    number = F.get(w, lead)
    skipped = lead + F.when(F.coalesce(F.get(w, lead + 1).isin(AFTER_NUMBER), F.lit(False)), 2).otherwise(1)
    numbered = F.coalesce(number.rlike("^[0-9]{1,2}$"), F.lit(False)) & (F.size(w) > skipped)
    turns = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.coalesce(F.get(w, i).isin(BECOMES) | (F.get(w, i).isin(INSTEAD) & (F.get(w, i + 1) == "jagah")), F.lit(False)))
    turn = F.get(turns, F.lit(0))
    behind = turn + F.when(F.get(w, turn).isin(INSTEAD), 2).otherwise(1)
    cloth = F.arrays_overlap(w, F.array(*map(F.lit, CLOTH)))
    none = F.lit(None).cast("string")
    named = lambda kind, n, old, new: F.struct(F.lit(kind).alias("kind"), n.alias("number"), old.alias("old"), new.alias("new"))
    return (
        F.when(cloth, named("cloth", none, none, said(F.filter(w, lambda x: ~x.isin(CLOTH)))))
        .when(numbered, named("ink", number, none, said(tail(skipped))))
        .when(turn.isNotNull(), named("swap", none, said(F.slice(w, F.lit(1), turn)), said(tail(behind))))
        .otherwise(named("unread", none, none, none))
    )


def rgb_of(hexed: str) -> dict[str, Column]:
    return {c: F.conv(F.substring(hexed, 2 + 2 * i, 2), 16, 10).cast("int") for i, c in enumerate("rgb")}


def parse_recolour(messages: DataFrame, inks: DataFrame) -> DataFrame:
    """id, target, hex, place: what each message (id, text) asks for; the last clause for a target wins. Target is an ink number, or ``cloth``.

    ``inks`` (id, ink, hex) are the design's inks, numbered from 1 as the message counts them. "pink ko navy" changes the ink that is nearest
    to the old colour, if it is within NEAR_INK; ties go to the smaller number. Clauses that aren't read, or name an ink that
    isn't there, have the target ``unread`` and keep their words. Null messages ask for nothing.
    """
    read = clauses(messages).withColumn("c", bound(F.col("words"), read_clause)).select("id", "place", "words", "c.*")
    old = read.where("kind = 'swap' and old is not null and new is not null").select("id", "place", "old")
    both = old.join(inks.select("id", "ink", "hex"), "id").withColumns({f"{k}p": v for k, v in rgb_of("old").items()} | {f"{k}q": v for k, v in rgb_of("hex").items()})
    far = layers.add(both, [*colour.lab("p", "rp", "gp", "bp"), *colour.lab("q", "rq", "gq", "bq"), {"far": colour.de76("p", "q")}])
    nearest = far.groupBy("id", "place").agg(F.min(F.struct("far", "ink")).alias("best")).where(F.col("best.far") <= NEAR_INK).select("id", "place", F.col("best.ink").alias("found"))
    known = inks.groupBy("id").agg(F.collect_set("ink").alias("there"))
    t = read.join(nearest, ["id", "place"], "left").join(known, "id", "left")
    asked = F.when(F.col("kind") == "ink", F.col("number").cast("int")).when(F.col("kind") == "swap", F.col("found"))
    good = F.col("new").isNotNull() & ((F.col("kind") == "cloth") | F.coalesce(F.array_contains("there", asked), F.lit(False)))
    t = t.select("id", "place", "words", F.col("new").alias("hex"), F.when(good, F.when(F.col("kind") == "cloth", "cloth").otherwise(asked.cast("string"))).otherwise("unread").alias("target"))
    won = t.where("target != 'unread'").groupBy("id", "target").agg(F.max_by("hex", "place").alias("hex"), F.max("place").alias("place"))
    return won.select("id", "target", "hex", "place").unionByName(t.where("target = 'unread'").select("id", "target", F.array_join("words", " ").alias("hex"), "place"))


def parse_plan(plans: DataFrame) -> DataFrame:
    """id, key, colour of plans such as ``A=cream, B C=red; 12 40-45=green``: ranges are spelled out, the later entry wins."""
    parts = plans.select("id", F.posexplode(F.split(F.translate(F.coalesce("text", F.lit("")), ";\n", ",,"), ",")).alias("place", "part")).where(F.col("part").contains("="))
    sides = parts.select("id", "place", F.trim(F.split_part("part", F.lit("="), F.lit(2))).alias("colour"), F.explode(F.split(F.trim(F.split_part("part", F.lit("="), F.lit(1))), r"\s+")).alias("key"))
    low, high = F.regexp_extract("key", r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract("key", r"^(\d+)-(\d+)$", 2).try_cast("int")
    keys = F.when(low.isNotNull() & high.isNotNull() & (low <= high), F.transform(F.sequence(low, F.greatest(low, high)), lambda n: n.cast("string"))).otherwise(F.array(F.upper("key")))
    return sides.select("id", "place", "colour", F.explode(keys).alias("key")).groupBy("id", "key").agg(F.max_by("colour", "place").alias("colour"))
