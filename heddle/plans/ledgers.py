"""Queries of the ledger jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import print_rules as rules
from ..operators import ledger as L
from . import fixtures as X
from .registry import query

NOW, DAYS = "2024-01-28 00:00:00", 20
EVENT_COLUMNS = {
    "seq": "event_id", "time": "ts", "event": "case when event_type in ('signup', 'error') then 'made' when event_type = 'purchase' then 'repeat' else 'stage' end",
    "job_id": "user_id * 20 + event_id % 20", "design": "case when event_id % 17 = 0 then '' else cast(user_id * 5 + event_id % 5 as string) end",
    "client": "case when user_id % 11 = 0 then '' when event_id % 3 = 0 then 'Client ' || cast(user_id % 40 as string) when event_id % 3 = 1 then '  CLIENT   ' || cast(user_id % 40 as string) || ' ' else 'client ' || cast(user_id % 40 as string) end",
    "status": "case when event_type = 'signup' then 'auto_ok' else 'needs_review' end",
    "stage": "case when event_type = 'view' then 'reviewed' when event_type = 'click' and event_id % 3 = 0 then 'approved' when event_type = 'click' and event_id % 3 = 1 then 'rejected' when event_type = 'click' then 'changed' end",
    "meters": "value", "quote_total": "floor(value * 7150e0 + 0.5e0) / 100e0", "seconds": "cast(regexp_extract(props, '([0-9]+)', 1) as double)",
}
EVENTS = "(select " + ", ".join(f"{e} as {c}" for c, e in EVENT_COLUMNS.items()) + " from events)"


def events(spark, d):
    return X.named(spark, d, "events").selectExpr(*[f"{e} as {c}" for c, e in EVENT_COLUMNS.items()])


KEY = r"lower(trim(regexp_replace(coalesce(client, ''), '\s+', ' ', 'g')))"
WINDOW = f"(select * from {EVENTS} ev where time >= timestamp '{NOW}' - interval {DAYS} days and time <= timestamp '{NOW}')"
STATE = """(select m.job_id, m.first_seq, m.seq, m.time, m.client, m.status, m.design, m.meters, m.quote_total, m.seconds, s.stage, s.stage_time from
(select * from (select *, min(seq) over (partition by job_id) as first_seq, row_number() over (partition by job_id order by seq desc) as rn from {0} a where event = 'made') z where rn = 1) m
left join lateral (select stage, time as stage_time from {0} b where b.job_id = m.job_id and b.event = 'stage' and b.seq > m.seq order by b.seq desc limit 1) s on true)"""
ALL_STATE, STATE_IN = STATE.format(EVENTS), STATE.format(WINDOW)
DESIGN = "coalesce(nullif(design, ''), cast(job_id as string))"
STATE_COLUMNS = "job_id, first_seq, seq, status, design, stage, round(meters, 4) as meters"


@query("l1_job_state", f"select {STATE_COLUMNS} from {ALL_STATE} q")
def _(spark, d):
    return L.job_state(events(spark, d)).selectExpr(*STATE_COLUMNS.split(", ", 6))


LATEST = f"(select * from (select *, row_number() over (partition by {DESIGN} order by first_seq desc) as rn2 from {STATE_IN} q) z where rn2 = 1)"


@query("l2_latest_per_design", f"select {STATE_COLUMNS} from {LATEST} q")
def _(spark, d):
    return L.latest_per_design(L.job_state(L.in_window(events(spark, d), DAYS, NOW))).selectExpr(*STATE_COLUMNS.split(", ", 6))


@query("l3_job_stats", f"""
with g as (select coalesce(stage, 'new') as stage, strftime(time, '%Y-%m-%d') as day, status, quote_total, meters from {LATEST} q),
s as (select stage, day, grouping(stage, day) as g, count(*) as designs, count(*) filter (status = 'auto_ok') as auto_ok, round_even(round(sum(quote_total), 2), 0) as quoted, round_even(round(sum(meters), 2), 0) as meters from g group by grouping sets ((), (stage), (day))),
w as (select sum(seconds) / 60 as engine, count(*) as runs from {STATE_IN} q), r as (select count(*) as repeats from {WINDOW} q where event = 'repeat')
select case g when 3 then 'total' when 1 then 'stage' else 'day' end as kind, coalesce(stage, day, '') as key, designs, auto_ok, quoted, meters,
  case when g = 3 then runs end as runs, case when g = 3 then repeats end as repeats,
  case when g = 3 then (round_even((greatest(0, designs * 60 - (designs - auto_ok) * 10 - engine) / 60) * 10, 0) / 10) end as hours_saved from s, w, r""")
def _(spark, d):
    return L.job_stats(events(spark, d), DAYS, NOW)


@query("l4_client_ledger", f"""
with j as (select *, {KEY} as client_key from {STATE_IN} q where {KEY} <> ''),
l as (select * from (select *, row_number() over (partition by client_key, {DESIGN} order by first_seq desc) as rn from j) z where rn = 1),
e as (select client_key, count(*) as designs, count(*) filter (stage = 'approved') as approved, count(*) filter (stage = 'rejected') as rejected,
  count(*) filter (coalesce(stage, 'new') not in ('approved', 'rejected', 'changed', 'expired')) as waiting, round_even(round(sum(meters), 2), 0) as meters, round_even(round(sum(quote_total), 2), 0) as quoted,
  round_even(round(sum(case when stage = 'approved' then quote_total else 0 end), 2), 0) as approved_quoted, max(coalesce(stage_time, time)) as last from l group by 1),
r as (select {KEY} as client_key, count(*) as repeat_orders, round_even(round(sum(quote_total), 2), 0) as repeat_quoted, max(time) as last_repeat from {WINDOW} q where event = 'repeat' and {KEY} <> '' group by 1)
select coalesce(e.client_key, r.client_key) as client_key, coalesce(designs, 0) as designs, coalesce(approved, 0) as approved, coalesce(rejected, 0) as rejected, coalesce(waiting, 0) as waiting,
  coalesce(repeat_orders, 0) as repeat_orders, coalesce(meters, 0) as meters, coalesce(quoted, 0) as quoted, coalesce(approved_quoted, 0) as approved_quoted, coalesce(repeat_quoted, 0) as repeat_quoted,
  coalesce(approved_quoted, 0) + coalesce(repeat_quoted, 0) as business, greatest(last, last_repeat) as last,
  coalesce(e.client_key, r.client_key) in (select 'client ' || (c_custkey % 40) from customer where c_custkey % 10 = 0) as own_rates
from e full join r on e.client_key = r.client_key""")
def _(spark, d):
    rated = X.named(spark, d, "customer").where("c_custkey % 10 = 0").selectExpr("'Client  ' || cast(c_custkey % 40 as string) as client")
    return L.client_ledger(events(spark, d), DAYS, NOW, rated)


PRICES = [("red bolt", 620.0), ("BLUE GEAR", 510.5), ("small ring", 275.0), ("#0B2F53", 700.0)]
PRICE_SQL = "(select * from (values " + ", ".join(f"('{k}', {v}::double)" for k, v in PRICES) + ") v(key, price))"
SHADE = "(p_partkey * 7) % 256 as r, (p_partkey * 13) % 256 as g, (p_partkey * 29) % 256 as b"
INKS = f"(select l.l_orderkey as job, p.p_name as name, printf('#%02X%02X%02X', (p_partkey * 7) % 256, (p_partkey * 13) % 256, (p_partkey * 29) % 256) as hex, least(100::double, l.l_quantity * 2) as coverage from lineitem l join part p on p.p_partkey = l.l_partkey)"
PRICED = f"(select i.*, coalesce(a.price, b.price, 450::double) as price from {INKS} i left join {PRICE_SQL} a on upper(a.key) = upper(i.name) left join {PRICE_SQL} b on upper(b.key) = upper(i.hex))"


def quote_inks(spark, d):
    from ..functions import colour

    part = X.named(spark, d, "part").selectExpr("p_partkey", "p_name", *[x.strip() for x in SHADE.split(",")]).selectExpr("p_partkey", "p_name as name", f"{colour.hex_digits()} as hex")
    lines = X.named(spark, d, "lineitem").selectExpr("l_orderkey as job", "l_partkey", "least(100e0, l_quantity * 2) as coverage")
    return lines.join(part, lines.l_partkey == part.p_partkey).select("job", "name", "hex", "coverage")


def priced(spark, d):
    return L.ink_prices(quote_inks(spark, d), spark.createDataFrame(PRICES, "key string, price double"))


@query("j10_ink_price", f"select name, hex, price, count(*) as n from {PRICED} q group by 1, 2, 3")
def _(spark, d):
    return priced(spark, d).groupBy("name", "hex", "price").agg(F.count("*").alias("n"))


MARGIN = "case when o_custkey % 10 = 0 then 10e0 + (o_custkey % 50) / 10e0 else 15e0 end"
JOBS = f"(select o_orderkey as job, round(o_totalprice / 1000, 1) as meters, {MARGIN} as margin_percent from orders)"


def quote_jobs(spark, d):
    """Jobs with their client's own margin where the card names one."""
    return X.named(spark, d, "orders").selectExpr("o_orderkey as job", "round(o_totalprice / 1000, 1) as meters", f"{MARGIN} as margin_percent")


def quote_sql(underbase: bool, ready: bool) -> str:
    lines = f"(select job, coverage, price from {PRICED} q" + (f" union all select job, least(100, sum(coverage)), 380::double from {PRICED} q group by 1)" if underbase else ")")
    cost = {"screens": "0::double" if ready else "(round_even((n * 1500::double) * 100, 0) / 100)", "ink": "(round_even((ink) * 100, 0) / 100)", "fabric": "0::double", "printing": "(round_even((meters * n * 6::double) * 100, 0) / 100)", "setup": "500::double"}
    lined = " + ".join(f"(round_even(({c} * up) * 100, 0) / 100)" for c in cost.values())
    return f"""
with l as (select l.job, j.meters, j.margin_percent, l.coverage * (j.meters * (44::double * 0.0254::double) * 80::double / 1000 * (1::double + 5::double / 100) / 100) as kg, l.price from {lines} l join {JOBS} j on j.job = l.job),
s as (select job, any_value(meters) as meters, 1::double + any_value(margin_percent) / 100 as up, count(*) as n, sum((round_even((kg * price) * 100, 0) / 100)) as ink, sum((round_even((kg) * 1000, 0) / 1000)) as kg from l group by 1),
b as (select *, (round_even(({lined}) * 100, 0) / 100) as before from s), t as (select *, (round_even((before + (round_even((before * 5::double / 100) * 100, 0) / 100)) * 100, 0) / 100) as total from b)
select job, n as screens, round(kg, 3) as kg, round(ink, 2) as ink_cost, before as before_tax, total, round(case when meters > 0 then total / meters else 0 end, 5) as per_meter from t"""


for name, kind in {"l5_quote": (False, False), "l6_quote_underbase": (True, False), "l7_quote_repeat_order": (False, True)}.items():

    @query(name, quote_sql(*kind))
    def _(spark, d, kind=kind):
        return L.quote(priced(spark, d), quote_jobs(spark, d), *kind)


FACTS = {
    "ceiling": "70 + avg(l_quantity)", "accuracy": "60 + avg(l_quantity)", "soft_edge": "avg(l_tax) * 150", "dot_share": "avg(l_discount) * 10",
    "similar_pairs": "count(*) % 3", "inks": "count(*) % 17", "source_ppi": "avg(l_extendedprice) / 400", "grain": "count(*) % 2", "repeat_axes": "count(*) % 5", "small": "count(*) % 4",
}
FACT_SQL = "(select l_suppkey as job, " + ", ".join(f"round({e}, 3) as {c}" for c, e in FACTS.items()) + " from lineitem group by 1)"
CODES = [("photographic", "ceiling < 80"), ("low_match", "accuracy < 85"), ("soft_edges", "soft_edge > 6"), ("tiny_dots", "dot_share > 0.5"), ("similar_inks", "similar_pairs > 0"), ("many_inks", "inks > 12"), ("low_resolution", "source_ppi < 100"), ("grainy_source", "grain > 0"), ("seamless_repeat", "repeat_axes > 0"), ("small_inks", "small > 0")]


@query("l9_review", f"select job, concat_ws(',', {', '.join(f'''case when {t} then '{c}' end''' for c, t in CODES)}) as warnings, case when {' or '.join(t for c, t in CODES[:7])} then 'needs_review' else 'auto_ok' end as status from {FACT_SQL} q")
def _(spark, d):
    facts = X.named(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("job")).agg(*[rules.rounded(F.expr(e), 3).alias(c) for c, e in FACTS.items()])
    return L.review(facts).select("job", "warnings", "status")


@query("l10_dashboard", f"""
select coalesce(stage, 'new') as stage, status, count(*) as n, count(*) filter (status = 'needs_review' and stage is null) as attention, max(seq) as newest from {ALL_STATE} q group by 1, 2""")
def _(spark, d):
    jobs = L.job_state(events(spark, d))
    return jobs.groupBy(F.coalesce("stage", F.lit("new")).alias("stage"), "status").agg(F.count("*").alias("n"), F.sum(((F.col("status") == "needs_review") & F.col("stage").isNull()).cast("long")).alias("attention"), F.max("seq").alias("newest"))


@query("l11_benchmark_summary", f"""
select coalesce(method, 'all') as method, count(*) as n, round(avg(case when status = 'auto_ok' then 1::double else 0 end), 4) as ok_share, round(avg(seconds), 4) as mean_s, round(quantile_cont(seconds, 0.5), 4) as median_s
from (select *, 'm' || (seq % 5) as method from {ALL_STATE} q) z group by rollup (method)""")
def _(spark, d):
    return L.benchmark_summary(L.job_state(events(spark, d)).withColumn("method", F.concat(F.lit("m"), (F.col("seq") % 5).cast("string"))))


@query("l12_truth_summary", """
select coalesce(o_orderpriority, 'all') as method, coalesce(o_orderstatus, 'all') as level, count(*) as n, round(avg(o_totalprice % 100), 3) as score
from orders group by rollup (o_orderpriority, o_orderstatus)""")
def _(spark, d):
    return X.named(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg(F.expr("o_totalprice % 100")), 3).alias("score")).select(F.coalesce("o_orderpriority", F.lit("all")).alias("method"), F.coalesce("o_orderstatus", F.lit("all")).alias("level"), "n", "score")


TRIALS = "(select o_custkey as design, case when o_orderpriority = '1-URGENT' then 'reduce' else o_orderpriority end as name, round(o_totalprice % 100, 2) as match from orders)"


@query("l13_fill_judge", f"""
with f as (select design, max(match) as match, arg_min(name, (-match, name)) as name from {TRIALS} q where name <> 'reduce' group by 1), b as (select design, max(match) as match from {TRIALS} q where name = 'reduce' group by 1),
j as (select coalesce(f.design, b.design) as design, f.name, f.match as fm, b.match as bm, round_even((f.match - b.match) * 10, 0) / 10 as margin from f full join b on f.design = b.design)
select design, case when fm is null or margin < -13 then 'reduce' else name end as chosen, round(fm, 4) as fill_match, round(bm, 4) as reduce_match, margin,
  case when fm is null then 'no_fill' when bm is null then 'no_reduce' when margin >= -13 then 'fill_close' else 'fill_far' end as reason from j""")
def _(spark, d):
    t = X.named(spark, d, "orders").selectExpr("o_custkey as design", "case when o_orderpriority = '1-URGENT' then 'reduce' else o_orderpriority end as name", "round(o_totalprice % 100, 2) as match")
    return L.decide(t)


@query("j12_attach_verdicts", """
with r as (select o_orderkey as run_id, o_custkey as name, o_orderdate as time from orders), f as (select o_orderkey as feedback_id, o_custkey as name, o_orderdate + interval 10 days as time from orders where o_orderstatus = 'F')
select feedback_id, name, run_id, run_time from (select f.feedback_id, f.name, r.run_id, r.time as run_time, row_number() over (partition by f.feedback_id, f.name, f.time order by r.time desc, r.run_id desc) as rn from f join r on r.name = f.name and r.time <= f.time) z where rn = 1""")
def _(spark, d):
    runs = X.named(spark, d, "orders").selectExpr("o_orderkey as run_id", "o_custkey as name", "o_orderdate as time")
    back = X.named(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as feedback_id", "o_custkey as name", "o_orderdate + interval 10 days as time")
    return L.attach_verdicts(runs, back)


@query("l14_library", f"""
with r as (select job_id, count(*) as repeats from {EVENTS} q where event = 'repeat' group by 1)
select s.job_id, seq, trim(client) as client, coalesce(repeats, 0) as repeats, row_number() over (order by stage_time desc, s.job_id) as rank from {ALL_STATE} s left join r on r.job_id = s.job_id where stage = 'approved' and contains(lower(client), 'client 1')""")
def _(spark, d):
    t = events(spark, d)
    return L.library(L.job_state(t), t.where("event = 'repeat'"), "client 1").select("job_id", "seq", F.trim("client").alias("client"), "repeats", "rank")


ORDERS = f"(select job_id as entry, case when seq % 7 = 0 then '' else 't' || (seq % 3) end as token, seq, meters from {EVENTS} q where event = 'repeat')"


@query("l15_add_repeats", f"select entry, token, seq, meters from (select *, row_number() over (partition by entry, token order by seq) as rn from {ORDERS} q) z where token = '' or rn = 1")
def _(spark, d):
    t = events(spark, d).where("event = 'repeat'").selectExpr("job_id as entry", "case when seq % 7 = 0 then '' else 't' || cast(seq % 3 as string) end as token", "seq", "meters")
    return L.add_repeats(t)


@query("l16_merge_log", f"""
with c as (select time, event, job_id, stage, seq from {EVENTS} q where seq % 3 <> 0), b as (select time, event, job_id, stage, seq from {EVENTS} q where seq % 2 = 0)
select time, event, job_id, stage, seq from c union all select time, event, job_id, stage, seq from b where not exists (select 1 from c where c.time = b.time and c.event = b.event and c.job_id = b.job_id and c.stage is not distinct from b.stage)""")
def _(spark, d):
    t = events(spark, d).select("time", "event", "job_id", "stage", "seq")
    return L.merge_log(t.where("seq % 3 <> 0"), t.where("seq % 2 = 0"))


FILES = "(select page_id as file_id, page_id * 3600 as mtime from pages)"


@query("l17_expired_files", """
with n as (select max(page_id) * 3600 as now from pages) select page_id as file_id, page_id * 3600 as mtime from pages, n
where page_id * 3600 < now - 172800 and not (page_id % 5 = 0 and page_id * 3600 >= now - 1209600)""")
def _(spark, d):
    files = X.named(spark, d, "pages").selectExpr("page_id as file_id", "page_id * 3600 as mtime")
    now = files.agg(F.max("mtime")).first()[0]
    return L.expired(files, files.where("file_id % 5 = 0").select("file_id"), now)


@query("l18_missing_images", "select distinct conv_id as file_id from conversations where conv_id * 3 not in (select page_id from pages)")
def _(spark, d):
    ids = X.named(spark, d, "conversations").selectExpr("conv_id as file_id", "conv_id * 3 as page_id").distinct()
    return ids.join(X.named(spark, d, "pages").select("page_id"), "page_id", "left_anti").select("file_id")


@query("l20_my_orders", f"""
select client_key, job_id, rank, more from (select {KEY} as client_key, job_id, row_number() over (partition by {KEY} order by seq desc) as rank, greatest(0, count(*) over (partition by {KEY}) - 10) as more from {ALL_STATE} q where {KEY} <> '') z where rank <= 10""")
def _(spark, d):
    jobs = L.job_state(events(spark, d)).withColumn("client_key", L.client_key(F.col("client"))).where("client_key != ''")
    return L.top_per_group(jobs, "client_key", [F.desc("seq")], 10).select("client_key", "job_id", "rank", "more")


@query("l21_batch_summary", """
select folder, result, count(*) as n, round(sum(grams), 1) as grams from (select l_returnflag as folder, l_quantity * 2.5 as grams, case when l_linenumber % 3 = 0 then 'OK' when l_linenumber % 3 = 1 and l_quantity > 25 then 'STOP' else 'CHECK' end as result from lineitem) z group by 1, 2""")
def _(spark, d):
    log = F.when(F.col("l_quantity") > 25, "reading\nSTOP too narrow").otherwise("reading, no STOP")
    result = rules.batch_result(F.col("l_linenumber") % 3, F.when(F.col("l_linenumber") % 3 == 1, log))
    return X.named(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("folder"), result.alias("result")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * 2.5), 1).alias("grams"))


@query("l24_swap_palette", f"""
with i as (select *, row_number() over (partition by job order by name, coverage, hex) as place from {INKS} q)
select job as owner, min(place)::int as place, hex, arg_min(name, place) as name, round(sum(coverage), 2) as coverage, count(*) as inks from i group by 1, 3""")
def _(spark, d):
    from pyspark.sql import Window

    from ..operators.score import swap_palette

    place = F.row_number().over(Window.partitionBy("job").orderBy("name", "coverage", "hex"))  # a job has a few inks
    return swap_palette(quote_inks(spark, d).withColumn("place", place).withColumnRenamed("job", "owner"))


@query("j11_client_rates", "select o_orderkey as job, case when c_custkey % 10 = 0 then 10 + (c_custkey % 50) / 10::double else 15 end as margin_percent, case when c_custkey % 20 = 0 then 1200::double else 1500 end as screen_cost from orders join customer on o_custkey = c_custkey")
def _(spark, d):
    own = X.named(spark, d, "customer").where("c_custkey % 10 = 0").selectExpr("c_name as client", "10 + (c_custkey % 50) / 10e0 as margin_percent", "case when c_custkey % 20 = 0 then 1200e0 end as screen_cost")
    jobs = X.named(spark, d, "orders").join(X.named(spark, d, "customer").selectExpr("c_custkey as o_custkey", "upper(c_name) as client"), "o_custkey")
    rates = own.withColumn("key", L.client_key(F.col("client"))).drop("client")
    return jobs.withColumn("key", L.client_key(F.col("client"))).join(rates, "key", "left").select(F.col("o_orderkey").alias("job"), F.coalesce("margin_percent", F.lit(15.0)).alias("margin_percent"), F.coalesce("screen_cost", F.lit(1500.0)).alias("screen_cost"))


FEATURES = {"a": "count(*)", "b": "avg(l_quantity)", "c": "avg(l_discount)", "e": "max(l_extendedprice)"}
FEATURE_SQL = "(select l_suppkey as run_id, " + ", ".join(f"round(cast({e} as double), 4) as {c}" for c, e in FEATURES.items()) + " from lineitem group by 1)"


@query("j13_similar_runs", f"""
with f as materialized (select * from {FEATURE_SQL} q), s as (select {', '.join(f'stddev_pop({c}) as s{c}' for c in FEATURES)} from f)
select asked_id, rank, run_id, distance from (select a.run_id as asked_id, f.run_id, round(sqrt({' + '.join(f'power((f.{c} - a.{c}) / s{c}, 2)' for c in FEATURES)}), 6) as distance,
 row_number() over (partition by a.run_id order by round(sqrt({' + '.join(f'power((f.{c} - a.{c}) / s{c}, 2)' for c in FEATURES)}), 6), f.run_id) as rank from f, f a, s where a.run_id % 10 = 0 and f.run_id <> a.run_id) z where rank <= 3""")
def _(spark, d):
    f = X.named(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run_id")).agg(*[rules.rounded(F.expr(e), 4).alias(c) for c, e in FEATURES.items()])
    return L.similar_runs(f.where("run_id % 10 = 0"), f, list(FEATURES))


@query("j14_verdict_bands", """
select l_orderkey as job, l_linenumber as line, case when l_discount * 10 >= 0.85 then 'good' when l_discount * 10 >= 0.55 then 'low' else 'very low' end as alignment,
  case when l_quantity * 2 >= 90 then 'good' when l_quantity * 2 >= 85 then 'near' else 'loose' end as match from lineitem""")
def _(spark, d):
    t = X.named(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("line"), rules.band(F.col("l_discount") * 10, rules.ALIGNMENT_BANDS).alias("alignment"), rules.band(F.col("l_quantity") * 2, rules.MATCH_BANDS).alias("match"))
