"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, let, words

SYMBOLS = "#*$%&|<>"


def repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the array ``w``; the first occurrence counts too."""

    def covered(found: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        add = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(found, start, add, lambda a: a["n"])

    def positions(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

    def marked(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes, marked))


def measures(text: Column, w: Column) -> dict[str, Column]:
    """The measures that rules use; ``w`` holds the words of ``text``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, "[ \\t-\\r]+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": repeat_words(w),
    }


def rules(m: dict[str, Column]) -> dict[str, Column]:
    """Each rule's rejection test. ``short`` and ``repeats`` are the base rules; the bounds of the others leave plain prose far inside."""
    return {
        "short": m["n_words"] < 50,
        "repeats": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    }


def plan_cascade(docs: DataFrame, names: list[str] | None = None, sample_rows: int = 400, turns: int = 4) -> list[str]:
    """Rule names by rejections per cost, best first, measured on about ``sample_rows`` documents, taken by a hash of their ids.

    A rule's cost is the time that its expression takes inside the task, read from the clock before and after it, row by row; of
    ``turns`` readings a row the least counts, so that neither scheduling nor compilation is measured. One job measures all rules.
    The order changes only the work: a document is rejected if any rule rejects it. An empty sample keeps the written order.
    """
    sample = hashed_sample(docs.select("doc_id", "text"), F.xxhash64("doc_id"), sample_rows)
    sample = sample.select(F.monotonically_increasing_id().alias("row"), "text", F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn")).withColumn("w", words(F.col("text")))
    tests = rules(measures(F.col("text"), F.col("w")))
    tests = {k: tests[k] for k in names or tests}
    clock = lambda: F.expr("cast(reflect('java.lang.System', 'nanoTime') as bigint)")
    read = sample.select("row", *[F.struct(clock().alias("begin"), F.coalesce(test, F.lit(False)).alias("rejects"), clock().alias("end")).alias(k) for k, test in tests.items()])
    rows = read.groupBy("row").agg(*[f for k in tests for f in (F.min(F.col(f"{k}.end") - F.col(f"{k}.begin")).alias(f"{k}_cost"), F.bool_or(f"{k}.rejects").cast("int").alias(f"{k}_rejects"))])
    found = rows.agg(*[F.avg(c).alias(c) for c in rows.columns if c != "row"]).first()
    if found is None or found[0] is None:
        return list(tests)
    return sorted(tests, key=lambda k: -found[f"{k}_rejects"] / max(found[f"{k}_cost"], 1.0))


def rejected_by(tests: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule, in ``order``, that rejects; null if none does. Later rules are not evaluated for rejected rows."""
    out = None
    for name in order:
        out = F.when(tests[name], F.lit(name)) if out is None else out.when(tests[name], F.lit(name))
    return out


def apply_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, with ``rejected_by``: the cascade's verdict alone. A column of that name gives way.

    A null or empty text has no words and is rejected as short. Equal rows get equal verdicts; an empty table stays empty.
    """
    order = order or plan_cascade(docs)
    inner = [c for c in docs.columns if c != "rejected_by"]
    # the words are bound inside the expression: a filter on it that moves below a projection would split the text anew for each word
    verdict = let(words(F.col("text")), lambda w: rejected_by(rules(measures(F.col("text"), w)), order))
    return docs.select(*[F.col(f"`{c}`") for c in inner], verdict.alias("rejected_by"))


def kept(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns as they are."""
    order = order or plan_cascade(docs)
    verdict = let(words(F.col("text")), lambda w: rejected_by(rules(measures(F.col("text"), w)), order))
    return docs.where(verdict.isNull())


def report(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, kept and rejected_by for every document."""
    order = order or plan_cascade(docs)
    found = let(words(F.col("text")), lambda w: F.struct(*[c.alias(k) for k, c in measures(F.col("text"), w).items()]))
    wide = docs.select("doc_id", found.alias("_m")).select("doc_id", "_m.*")
    tests = rules({k: F.col(k) for k in wide.columns if k != "doc_id"})
    wide = wide.withColumn("base_failed", tests["short"] | tests["repeats"]).withColumn("rejected_by", rejected_by(tests, order))
    return wide.withColumn("kept", F.col("rejected_by").isNull() & ~F.col("base_failed"))
