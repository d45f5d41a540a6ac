"""Design files, job logs, run logs, reports, ink lists and packages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import safe_cell

#: Columns of the job log, all text; an older log lacks the last ones.
LOG_COLUMNS = "time event job_id name client status stage inks accuracy seconds width_in meters quote_total currency by note design".split()
NUMBERS = "inks accuracy seconds width_in meters quote_total".split()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of a folder, damaged ones included: origin, height, width, channels, data."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def screen_inputs(files: DataFrame, most: int = 70_000_000) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) files; a rejected one says why."""
    why = F.when((F.col("width") <= 0) | (F.col("height") <= 0) | F.col("data").isNull(), "damaged").when(F.col("width").cast("long") * F.col("height") > most, "too large")
    marked = files.withColumn("reason", why)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("origin", "width", "height", "reason")


def pixels_of(files: DataFrame) -> DataFrame:
    """Pixel rows of image rows: design, x, y, r, g, b, a. Images come as blue, green, red (, alpha) bytes, row by row."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                grid = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels).astype("int16")
                b, g, r = (grid[..., min(i, row.channels - 1)].ravel() for i in range(3))
                a = grid[..., 3].ravel() if row.channels == 4 else np.full(len(r), 255, "int16")
                y, x = np.divmod(np.arange(len(r)), row.width)
                yield pd.DataFrame({"design": row.origin, "x": x, "y": y, "r": r, "g": g, "b": b, "a": a})

    return files.select("origin", "height", "width", "channels", "data").mapInPandas(unpack, "design string, x int, y int, r short, g short, b short, a short")


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    """The job log as text columns in today's order, numbers as doubles (unreadable ones 0), missing columns empty, the byte mark gone."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    bare = lambda c: F.when(c.rlike("^'[=+\\-@\t\r]"), F.substring(c, 2, 1 << 30)).otherwise(c)
    raw = raw.select(*[bare(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    have = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in LOG_COLUMNS]
    return raw.select(*have).withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in NUMBERS})


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; half-written lines are left out."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    text = spark.read.text(path).select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return text.select("r.*").where("_corrupt_record is null").drop("_corrupt_record")


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Job reports, one JSON file each, without damaged ones and those that lack a job id."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    return spark.read.schema(full).option("multiLine", True).json(path).where("_corrupt_record is null and job_id is not null").drop("_corrupt_record")


def parse_ink_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inks, errors) of lines with a name and a #hex in any order; blank lines are neither."""
    code = F.upper(F.regexp_extract("line", r"#?\b([0-9A-Fa-f]{6})\b", 1))
    name = F.trim(F.regexp_replace(F.regexp_replace("line", r"#?\b[0-9A-Fa-f]{6}\b", " "), r"[,;=:\s]+", " "))
    read = lines.where("trim(line) != ''").select("line", name.alias("name"), code.alias("_h"))
    good = (F.col("_h") != "") & (F.col("name") != "")
    return read.where(good).select("name", F.concat(F.lit("#"), "_h").alias("hex")), read.where(~good).select("line")


def pair_files(files: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """(pairs, alone): files NAME_lineart with NAME_ref, _colored or _reference; the first of these suffixes wins."""
    stem = F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", "")
    t = files.select(name.alias("file"), F.regexp_extract(stem, r"^(.*)_(lineart|ref|colored|reference)$", 1).alias("key"), F.regexp_extract(stem, r"_(lineart|ref|colored|reference)$", 1).alias("kind"))
    lines = t.where("kind = 'lineart'").groupBy("key").agg(F.min("file").alias("lineart"))
    rank = F.when(F.col("kind") == "ref", 1).when(F.col("kind") == "colored", 2).otherwise(3)
    refs = t.where("kind in ('ref', 'colored', 'reference')").groupBy("key").agg(F.min_by("file", F.struct(rank, "file")).alias("reference"))
    pairs = lines.join(refs, "key")
    return pairs, t.where("kind != ''").join(pairs.select("key"), "key", "left_anti").select("file", "kind")


def write_package(screens: DataFrame, stems: DataFrame, path: str) -> None:
    """Screens as one folder per design and file stem. ``stems``: d, screen, stem."""
    rows = screens.join(stems, ["d", "screen"])
    rows.repartition("d", "stem").sortWithinPartitions("d", "stem", "y", "x").write.mode("overwrite").partitionBy("d", "stem").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Appends events as CSV, with cells that a spreadsheet won't run."""
    cells = [safe_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in events.columns]
    events.select(*cells).write.mode("append").option("header", True).csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Appended events as text columns, with the quotes before formula-like cells taken away again."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    plain = lambda c: F.coalesce(F.when(c.rlike("^'[=+\\-@\t\r]"), F.substring(c, 2, 1 << 30)).otherwise(c), F.lit(""))
    return raw.select(*[plain(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def latest(rows: DataFrame, kind: str, order: str, n: int = 500) -> DataFrame:
    """The newest ``n`` rows of each kind."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")
