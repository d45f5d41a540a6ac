"""The given tables as the logical tables of the jobs, for Spark and as SQL.

A document is a design: character p of its text is the pixel x = p % 64, y = p div 64, coloured by its code point. Rasters are
dense but for the end of their last row, where neighbours are missing as beyond any edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Vowels with and without accents.
VOWELS = "aeiouAEIOUàáâãäåèéêëìíîïòóôõöùúûüÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ"
INK = f"case when cp = 33 then -1 when cp = 32 then 0 when cp in ({', '.join(str(ord(c)) for c in VOWELS)}) then 1 when cp between 65 and 90 or cp between 97 and 122 or (cp >= 192 and cp <> 215 and cp <> 247) then 2 else 3 end"
RGB = {"r": "(cp * 37) % 256", "g": "(cp * 59) % 256", "b": "(cp * 83) % 256", "a": "case when cp = 33 then 0 else 255 end"}
SOFT = {c: f"({e} + x * 3 + y * 5) % 256" for c, e in RGB.items() if c != "a"} | {"a": RGB["a"]}
#: Six inks of every design unless a job makes its own.
PALETTE = [(0, 255, 255, 255), (1, 20, 20, 20), (2, 200, 16, 46), (3, 31, 95, 191), (4, 46, 139, 58), (5, 246, 209, 15)]

CHARS = "(select doc_id as d, cast(p % 64 as int) as x, cast(p // 64 as int) as y, unicode(c) as cp from (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) - 1 as p from documents where length(text) > 0))"
PIXELS = f"(select d, x, y, cp, {', '.join(f'{e} as {c}' for c, e in RGB.items())} from {CHARS})"
PIXELS_SOFT = f"(select d, x, y, cp, {', '.join(f'{e} as {c}' for c, e in SOFT.items())} from {CHARS})"
LABELS = f"(select d, x, y, {INK} as ink from {CHARS})"
PALETTE_SQL = "(select * from (values " + ", ".join(map(str, PALETTE)) + ") v(ink, pr, pg, pb))"


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 0")
    return docs.selectExpr("doc_id as d", "posexplode(split(text, '')) as (p, c)").selectExpr("d", "p % 64 as x", "cast(p div 64 as int) as y", "ascii(c) as cp")


def pixels(spark: SparkSession, sf_dir: str, soft: bool = False) -> DataFrame:
    return chars(spark, sf_dir).selectExpr("d", "x", "y", "cp", *[f"{e} as {c}" for c, e in (SOFT if soft else RGB).items()])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chars(spark, sf_dir).selectExpr("d", "x", "y", f"{INK} as ink")


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PALETTE, "ink int, pr int, pg int, pb int")


def named(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
