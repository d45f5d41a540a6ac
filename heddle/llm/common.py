"""Pieces that several operators share: word expressions, lineage cuts, block-wise running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and 0x09 to 0x0D.
SPACES = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_heddle_dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._heddle_dir = path
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: smaller than a checkpoint and read by column."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/heddle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._heddle_path = path
    return out


def done(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: whatever was made of them must be written by now."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._heddle_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until ``df`` has no such column."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        out.append(name)
    return out


#: Bytes that a broadcast table may have, by the width of its columns.
SMALL_BYTES = 32 << 20


def width(df: DataFrame) -> int:
    """Bytes of a row, roughly: 8 a number, 48 a string, 64 anything else, and 16 for the row."""
    kinds = {"bigint": 8, "int": 8, "double": 8, "boolean": 8, "string": 48}
    return 16 + sum(kinds.get(kind, 64) for _, kind in df.dtypes)


def small(df: DataFrame, most: int, ready: bool = False) -> DataFrame:
    """A broadcast hint, only if the counted rows stay within ``most`` and ``SMALL_BYTES``; beyond, Spark shuffles the join.

    The rows are made once: they are cut from their lineage first, unless they are ``ready``.
    """
    df = df if ready else cut(df)
    return F.broadcast(df) if df.count() <= min(most, SMALL_BYTES // width(df)) else df


def hashed_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows at most, those whose 64-bit hash ``key`` lies in a range sized by the count; all rows if there are no more.

    No partition hands over more than its share. The limit behind it holds the bound where many rows have one hash.
    """
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * 0.95 * most / n)).limit(most)


#: A key is frequent from this share of all rows on, so at most so many keys are.
FREQUENT = 2000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, counted: str, total: int, few: int = 0) -> DataFrame:
    """``rows`` joined (inner) with ``facts``, one row a ``key``, so that no task gets all rows of a frequent key.

    ``counted`` is a column of ``facts`` (dropped) with the number of rows that have the key. Keys of more than ``total`` / FREQUENT rows
    are fewer than FREQUENT, so their facts are broadcast; the others are joined by a shuffle. Up to ``few`` rows in all, which one task
    can hold, a plain join does.
    """
    if total <= few:
        return rows.join(facts.drop(counted), key)
    frequent = F.col(counted) * FREQUENT > F.lit(total)
    facts = facts.withColumn("_frequent", frequent).drop(counted)
    many = F.broadcast(facts.where("_frequent").drop("_frequent").withColumn("_there", F.lit(True)))
    marked = rows.join(many, key, "left")
    names = [c for c in facts.columns if c not in (key, "_frequent")]
    rest = marked.where("_there is null").drop(*names, "_there").join(facts.where("not _frequent").drop("_frequent"), key)
    return marked.where("_there").drop("_there").unionByName(rest)


def salted_join(rows: DataFrame, facts: DataFrame, key: str, salt: Column, each: int, total: int) -> DataFrame:
    """``rows`` joined (inner) with ``facts``, one wide row a ``key``, so that no task gets all rows of a frequent key.

    Keys of more than ``total`` / FREQUENT rows, fewer than FREQUENT, are counted and their rows dealt by ``salt`` into parts of about ``each`` rows;
    their facts are copied to each part. Only key and number of parts are broadcast, so facts may be of any width.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") * FREQUENT > F.lit(total)) & (F.col("_n") > each))
    parts = small(counts.select(key, F.ceil(F.col("_n") / each).cast("int").alias("_parts")), FREQUENT)
    dealt = rows.join(parts, key, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(salt, F.col("_parts"))).cast("int")).drop("_parts")
    copied = facts.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def running(df: DataFrame, group: str, block: str, order: list[str], value: Column, out: str, most: int = 200_000) -> DataFrame:
    """Sum of ``value`` over the rows that come before, in each ``group`` by ``block`` and then ``order``.

    No task sees more than one block of a group: totals by block are summed first and join back as offsets.
    ``group`` and ``block`` must not be null. Rows equal in all of ``order`` are interchangeable.
    """
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(group, block).agg(F.sum(value).alias("_t")).select(group, block, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return ranked.join(small(bases, most), [group, block]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")
