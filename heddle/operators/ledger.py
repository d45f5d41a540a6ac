"""Ledger jobs: job state, statistics, clients, quotes, reviews, library, expiry and backups, from append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.print_rules import rounded

# The rate card's settings and the review's limits.
CARD = {
    "screen_cost": 1500.0, "ink_per_kg": 450.0, "underbase_ink_per_kg": 380.0, "ink_g_per_sqm": 80.0, "fabric_width_in": 44.0, "fabric_per_meter": 0.0,
    "labour_per_meter_per_screen": 6.0, "setup_per_job": 500.0, "wastage_percent": 5.0, "margin_percent": 15.0, "gst_percent": 5.0,
    "manual_minutes_per_design": 60.0, "review_minutes_per_design": 10.0, "staff_cost_per_hour": 200.0,
}
LIMITS = {"min_accuracy": 85.0, "photographic_ceiling": 80.0, "max_tiny_dot_share": 0.5, "max_inks": 12, "min_source_ppi": 100.0, "soft_edge_limit": 6.0}
BLOCKING = ("photographic", "low_match", "soft_edges", "tiny_dots", "similar_inks", "many_inks", "low_resolution")


def even(value: Column, places: int) -> Column:
    """Rounded to ``places``, halves to even, on the scaled double."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rint(value * 10.0**places) / 10.0**places


def client_key(name: Column) -> Column:
    """A client's name as matched: trimmed, inner spaces squeezed, case folded."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "\\s+", " ")))


def in_window(events: DataFrame, days: int, now: str) -> DataFrame:
    """Events of the last ``days`` days up to ``now``; cut before any state is built, as the state must not see older ones."""
    end = F.lit(now).cast("timestamp")
    return events.where((F.col("time") >= end - F.expr(f"interval {days} days")) & (F.col("time") <= end))


def job_state(events: DataFrame) -> DataFrame:
    """Each job's last ``made`` row with the last stage after it; a later ``made`` starts the job anew, but its place stays the first one's.

    Two aggregations by job, no window: a job of very many events is combined before the shuffle.
    """
    made = events.where("event = 'made'").groupBy("job_id").agg(F.min("seq").alias("first_seq"), F.max(F.struct("seq", "time", "client", "status", "design", "meters", "quote_total", "seconds")).alias("m"))
    stages = events.where("event = 'stage'").select("job_id", "seq", "stage", F.col("time").alias("stage_time"))
    later = stages.join(made.select("job_id", F.col("m.seq").alias("_made")), "job_id").where("seq > _made").groupBy("job_id").agg(F.max(F.struct("seq", "stage", "stage_time")).alias("s"))
    return made.join(later, "job_id", "left").select("job_id", "first_seq", "m.*", F.col("s.stage").alias("stage"), F.col("s.stage_time").alias("stage_time"))


def latest_per_design(jobs: DataFrame, *by: str) -> DataFrame:
    """One job a design (a job without design is its own): the one whose job was first seen last."""
    keyed = jobs.withColumn("_design", F.coalesce(F.when(F.col("design") != "", F.col("design")), F.col("job_id").cast("string")))
    best = keyed.groupBy(*by, "_design").agg(F.max(F.struct(F.col("first_seq").alias("_first"), *jobs.columns)).alias("_b"))
    return best.select(*[F.col(f"_b.{c}").alias(c) for c in jobs.columns], *by)


def job_stats(events: DataFrame, days: int, now: str) -> DataFrame:
    """Total, by stage and by day in one pass of grouping sets: designs, auto_ok, quoted and meters; hours and money saved in the total."""
    rows = in_window(events, days, now)
    jobs = job_state(rows)
    designs = latest_per_design(jobs).select(F.coalesce("stage", F.lit("new")).alias("stage"), F.date_format("time", "yyyy-MM-dd").alias("day"), "status", "quote_total", "meters")
    sets = designs.groupingSets([[], ["stage"], ["day"]], "stage", "day").agg(F.count("*").alias("designs"), F.sum((F.col("status") == "auto_ok").cast("long")).alias("auto_ok"), even(F.round(F.sum("quote_total"), 2), 0).alias("quoted"), even(F.round(F.sum("meters"), 2), 0).alias("meters"), F.grouping_id().alias("_g"))
    whole = jobs.agg((F.sum("seconds") / 60).alias("_engine"), F.count("*").alias("runs"))
    again = rows.where("event = 'repeat'").agg(F.count("*").alias("repeats"))
    saved = F.greatest(F.lit(0.0), F.col("designs") * CARD["manual_minutes_per_design"] - (F.col("designs") - F.col("auto_ok")) * CARD["review_minutes_per_design"] - F.col("_engine"))
    total = F.col("_g") == 3
    out = sets.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(again))
    return out.select(F.when(total, "total").when(F.col("_g") == 1, "stage").otherwise("day").alias("kind"), F.coalesce("stage", "day", F.lit("")).alias("key"), "designs", "auto_ok", "quoted", "meters", F.when(total, F.col("runs")).alias("runs"), F.when(total, F.col("repeats")).alias("repeats"), F.when(total, even(saved / 60, 1)).alias("hours_saved"))


def client_ledger(events: DataFrame, days: int, now: str, rated: DataFrame) -> DataFrame:
    """Each client's designs, where they ended, meters and money, and repeat orders; the spelling of the latest row is shown."""
    rows = in_window(events, days, now)
    jobs = job_state(rows).withColumn("client_key", client_key(F.col("client"))).where("client_key != ''")
    jobs = _latest_by_client(jobs)
    stage = F.coalesce("stage", F.lit("new"))
    one = lambda cond: F.sum(cond.cast("long"))
    ended = jobs.groupBy("client_key").agg(
        F.count("*").alias("designs"), one(stage == "approved").alias("approved"), one(stage == "rejected").alias("rejected"),
        one(~stage.isin("approved", "rejected", "changed", "expired")).alias("waiting"), even(F.round(F.sum("meters"), 2), 0).alias("meters"), even(F.round(F.sum("quote_total"), 2), 0).alias("quoted"),
        even(F.round(F.sum(F.when(stage == "approved", F.col("quote_total")).otherwise(0.0)), 2), 0).alias("approved_quoted"), F.max(F.coalesce("stage_time", "time")).alias("last"))
    again = rows.where("event = 'repeat'").withColumn("client_key", client_key(F.col("client"))).where("client_key != ''")
    repeats = again.groupBy("client_key").agg(F.count("*").alias("repeat_orders"), even(F.round(F.sum("quote_total"), 2), 0).alias("repeat_quoted"), F.max("time").alias("last_repeat"))
    own = rated.select(client_key(F.col("client")).alias("client_key")).distinct().withColumn("own_rates", F.lit(True))
    zero = lambda c, v=0: F.coalesce(c, F.lit(v)).alias(c)
    out = ended.join(repeats, "client_key", "full").join(own, "client_key", "left")
    counts = [zero(c) for c in ("designs", "approved", "rejected", "waiting", "repeat_orders")] + [zero(c, 0.0) for c in ("meters", "quoted", "approved_quoted", "repeat_quoted")]
    return out.select("client_key", *counts, (F.coalesce("approved_quoted", F.lit(0.0)) + F.coalesce("repeat_quoted", F.lit(0.0))).alias("business"), F.greatest("last", "last_repeat").alias("last"), F.coalesce("own_rates", F.lit(False)).alias("own_rates"))


def _latest_by_client(jobs: DataFrame) -> DataFrame:
    keyed = jobs.withColumn("_design", F.coalesce(F.when(F.col("design") != "", F.col("design")), F.col("job_id").cast("string")))
    best = keyed.groupBy("client_key", "_design").agg(F.max(F.struct("first_seq", "stage", "meters", "quote_total", "time", "stage_time")).alias("_b"))
    return best.select("client_key", "_b.*")


def ink_prices(inks: DataFrame, prices: DataFrame, default: float = CARD["ink_per_kg"]) -> DataFrame:
    """Price of each ink: by its name, else by its hex, else the default; case doesn't matter. The price list is small and broadcast."""
    by = prices.select(F.upper("key").alias("_key"), F.col("price").alias("_price"))
    name, hexed = [F.broadcast(by.select(F.col("_key").alias(f"_k{n}"), F.col("_price").alias(f"_p{n}"))) for n in (1, 2)]
    out = inks.join(name, F.upper("name") == F.col("_k1"), "left").join(hexed, F.upper("hex") == F.col("_k2"), "left")
    return out.withColumn("price", F.coalesce("_p1", "_p2", F.lit(default))).drop("_k1", "_k2", "_p1", "_p2")


def quote(inks: DataFrame, jobs: DataFrame, underbase: bool = False, screens_ready: bool = False) -> DataFrame:
    """Cost and price of each job's run. ``inks``: job, coverage, price, one row a screen; ``jobs``: job, meters, margin_percent.

    Rounds half to even, at the places where the money is shown. With ``underbase`` a white screen is added whose cover is the
    inks' sum, capped at 100; with ``screens_ready`` no screen is charged.
    """
    waste = 1 + CARD["wastage_percent"] / 100
    per_percent = F.col("meters") * (CARD["fabric_width_in"] * 0.0254) * CARD["ink_g_per_sqm"] / 1000 * waste / 100
    lines = inks.select("job", "coverage", "price")
    if underbase:
        white = lines.groupBy("job").agg(F.least(F.lit(100.0), F.sum("coverage")).alias("coverage")).withColumn("price", F.lit(CARD["underbase_ink_per_kg"]))
        lines = lines.unionByName(white)
    lines = lines.join(jobs, "job").withColumn("kg", F.col("coverage") * per_percent)
    sums = lines.groupBy("job").agg(F.first("meters").alias("meters"), F.first("margin_percent").alias("margin_percent"), F.count("*").alias("screens"), F.sum(even(F.col("kg") * F.col("price"), 2)).alias("ink"), F.sum(even("kg", 3)).alias("kg"))
    up = 1 + F.col("margin_percent") / 100
    cost = {
        "screens_cost": F.lit(0.0) if screens_ready else F.col("screens") * CARD["screen_cost"], "ink_cost": F.col("ink"), "fabric_cost": F.col("meters") * waste * CARD["fabric_per_meter"],
        "printing_cost": F.col("meters") * F.col("screens") * CARD["labour_per_meter_per_screen"], "setup_cost": F.lit(CARD["setup_per_job"]),
    }
    out = sums.select("*", *[even(c, 2).alias(n) for n, c in cost.items()])
    before = even(sum((even(F.col(n) * up, 2) for n in cost), F.lit(0.0)), 2)
    out = out.withColumn("before_tax", before).withColumn("gst", even(F.col("before_tax") * CARD["gst_percent"] / 100, 2)).withColumn("total", even(F.col("before_tax") + F.col("gst"), 2))
    return out.select("job", "screens", F.round("kg", 3).alias("kg"), F.round("ink_cost", 2).alias("ink_cost"), "before_tax", "total", F.round(F.when(F.col("meters") > 0, F.col("total") / F.col("meters")).otherwise(0.0), 5).alias("per_meter"))


def review(facts: DataFrame) -> DataFrame:
    """Warning codes of each job, in a fixed order, and whether any of them blocks it."""
    rules = [
        ("photographic", F.col("ceiling") < LIMITS["photographic_ceiling"]), ("low_match", F.col("accuracy") < LIMITS["min_accuracy"]), ("soft_edges", F.col("soft_edge") > LIMITS["soft_edge_limit"]),
        ("tiny_dots", F.col("dot_share") > LIMITS["max_tiny_dot_share"]), ("similar_inks", F.col("similar_pairs") > 0), ("many_inks", F.col("inks") > LIMITS["max_inks"]),
        ("low_resolution", F.col("source_ppi") < LIMITS["min_source_ppi"]), ("grainy_source", F.col("grain") > 0), ("seamless_repeat", F.col("repeat_axes") > 0), ("small_inks", F.col("small") > 0),
    ]
    marked = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules])
    out = facts.withColumn("codes", F.filter(marked, lambda c: c.isNotNull()))
    held = F.exists("codes", lambda c: c.isin(*BLOCKING))
    return out.withColumn("warnings", F.array_join("codes", ",")).withColumn("status", F.when(held, "needs_review").otherwise("auto_ok"))


def decide(trials: DataFrame, tolerance: float = 13.0) -> DataFrame:
    """By design: the chosen method, the best fill's match (the earlier name on a tie) against reduce's, the margin and the reason.

    A fill is chosen if its match is at most ``tolerance`` under reduce's, or if there is no reduce to hold it against.
    """
    fills = trials.where("name != 'reduce'").groupBy("design").agg(F.min(F.struct((-F.col("match")).alias("less"), "name", "match")).alias("f"))
    base = trials.where("name = 'reduce'").groupBy("design").agg(F.max("match").alias("reduce"))
    out = fills.join(base, "design", "full").withColumn("margin", even(F.col("f.match") - F.col("reduce"), 1))
    reason = F.when(F.col("f").isNull(), "no_fill").when(F.col("reduce").isNull(), "no_reduce").when(F.col("margin") >= -tolerance, "fill_close").otherwise("fill_far")
    out = out.withColumn("reason", reason)
    chosen = F.when(F.col("reason").isin("no_fill", "fill_far"), "reduce").otherwise(F.col("f.name"))
    return out.select("design", chosen.alias("chosen"), F.round("f.match", 4).alias("fill_match"), F.round("reduce", 4).alias("reduce_match"), "margin", "reason")


def attach_verdicts(runs: DataFrame, feedback: DataFrame, days: int = 30) -> DataFrame:
    """Each feedback with the run that its run_id names, else the latest run of its name at its time or before.

    Both sides are put in one order by name and time, and the last run so far is carried on: sorting, not pairing. A busy name is cut
    into blocks of ``days`` days; the last run before each block comes from one row a block.
    """
    named = "run_id" in feedback.columns
    moment = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    block = F.floor(F.col("_at") / F.lit(days * 86_400_000_000))
    r = runs.select("name", moment("time").alias("_at"), F.struct(F.col("time").alias("run_time"), "run_id").alias("_run")).withColumn("_b", block)
    asked = feedback.where("run_id is null").drop("run_id") if named else feedback
    f = asked.select("feedback_id", "name", moment("time").alias("_at")).withColumn("_b", block)
    lines = r.withColumn("feedback_id", F.lit(None).cast(dict(f.dtypes)["feedback_id"])).unionByName(f, allowMissingColumns=True)
    order = Window.partitionBy("name", "_b").orderBy("_at", F.col("feedback_id").isNotNull(), F.col("_run.run_id"))
    inside = F.last("_run", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = lines.withColumn("_r", inside).where("feedback_id is not null").select("feedback_id", "name", "_b", "_r")
    ends = r.groupBy("name", "_b").agg(F.max("_run").alias("_end")).withColumn("_next", F.lead("_b").over(Window.partitionBy("name").orderBy("_b")))
    open_ = found.where("_r is null").select("feedback_id", "name", "_b")
    heads = ends.select("name", F.col("_b").alias("_from"), F.coalesce("_next", F.lit(1 << 40)).alias("_to"), "_end")
    earlier = open_.join(heads, "name").where("_from < _b and _b <= _to").groupBy("feedback_id", "name").agg(F.max("_end").alias("_r"))
    latest = found.where("_r is not null").select("feedback_id", "name", "_r").unionByName(earlier)
    out = latest.select("feedback_id", "name", "_r.run_id", "_r.run_time")
    if not named:
        return out
    own = feedback.where("run_id is not null").select("feedback_id", "run_id").join(runs.select("run_id", "name", F.col("time").alias("run_time")), "run_id")
    return out.unionByName(own.select("feedback_id", "name", "run_id", "run_time"))


def library(jobs: DataFrame, repeats: DataFrame, query: str = "", parts: int = 4096) -> DataFrame:
    """Approved jobs whose client or design holds ``query``, with how many repeat orders each has had, ranked newest approval first.

    ``jobs``: as of ``job_state``, whose latest approval counts. Ranks are made in ranges of approval times: each range is ranked by itself,
    and the counts of the ranges before it are added, so no task ranks all rows.
    """
    text = F.lower(F.concat_ws(" ", "client", "design"))
    kept = jobs.where(F.col("stage") == "approved").where(F.contains(text, F.lit(query.lower())) if query else F.lit(True))
    orders = repeats.groupBy("job_id").agg(F.count("*").alias("repeats"))
    kept = kept.join(orders, "job_id", "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    low, high = kept.agg(F.min(F.unix_micros(F.col("stage_time").cast("timestamp"))), F.max(F.unix_micros(F.col("stage_time").cast("timestamp")))).first()
    step = max(1, ((high or 0) - (low or 0)) // parts + 1)
    kept = kept.withColumn("_part", F.floor((F.unix_micros(F.col("stage_time").cast("timestamp")) - F.lit(low or 0)) / F.lit(step)))
    counts = kept.groupBy("_part").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most ``parts`` rows
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("stage_time"), "job_id"))
    return kept.withColumn("_in", inside).join(F.broadcast(before.drop("count")), "_part").withColumn("rank", (F.col("_before") + F.col("_in")).cast("int")).drop("_part", "_in", "_before")


def add_repeats(orders: DataFrame) -> DataFrame:
    """Repeat orders once per entry and token, the first by sequence; those with a blank token all stay."""
    first = orders.where("token != ''").groupBy("entry", "token").agg(F.min(F.struct("seq", "meters")).alias("o")).select("entry", "token", "o.*")
    return first.unionByName(orders.where("token = ''").select("entry", "token", "seq", "meters"))


def merge_log(current: DataFrame, backup: DataFrame, keys=("time", "event", "job_id", "stage")) -> DataFrame:
    """The log with the backup's lines that it lacks, known events only."""
    known = backup.where(F.col("event").isin("made", "stage", "repeat")).dropDuplicates(list(keys))
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return current.unionByName(known.alias("b").join(current.alias("c"), on, "left_anti"))


def expired(files: DataFrame, protected: DataFrame, now: int, short_s: int = 48 * 3600, long_s: int = 14 * 86400) -> DataFrame:
    """Files older than 48 hours, unless they await a decision and are younger than 14 days."""
    old = files.where(F.col("mtime") < now - short_s)
    kept = protected.select("file_id").distinct().withColumn("_held", F.lit(True))
    return old.join(kept, "file_id", "left").where(F.col("_held").isNull() | (F.col("mtime") < now - long_s)).drop("_held")


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """Share of good results, mean and median seconds, by method, and in all (rollup)."""
    return rows.rollup("method").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "auto_ok").cast("double")), 4).alias("ok_share"), F.round(F.avg("seconds"), 4).alias("mean_s"), F.round(F.percentile("seconds", F.lit(0.5)), 4).alias("median_s")).select(F.coalesce("method", F.lit("all")).alias("method"), "n", "ok_share", "mean_s", "median_s")


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group and how many more there are."""
    w = Window.partitionBy(group)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(w) - n)).where(F.col("rank") <= n)


def similar_runs(asked: DataFrame, log: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """The k nearest past runs of each asked run, every feature scaled by its spread in the log.

    ``asked`` is a stated set of queries held against the whole log; it is broadcast up to 100,000 counted rows, and beyond that Spark
    pairs the blocks of both sides.
    """
    spread = log.agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    sides = asked.select(F.col("run_id").alias("asked_id"), *[F.col(c).alias(f"a_{c}") for c in features])
    sides = F.broadcast(sides) if sides.count() <= 100_000 else sides
    pairs = log.crossJoin(sides).where("run_id != asked_id").crossJoin(F.broadcast(spread))
    terms = [F.pow((F.col(c) - F.col(f"a_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0), 2.0) for c in features]
    pairs = pairs.withColumn("distance", rounded(F.sqrt(sum(terms, F.lit(0.0))), 6))
    rank = F.row_number().over(Window.partitionBy("asked_id").orderBy("distance", "run_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("asked_id", "rank", "run_id", "distance")
