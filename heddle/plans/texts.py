"""Queries of the text, geometry and file jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import print_rules as R
from ..functions import text as T
from . import fixtures as X
from .registry import query

REQUEST = "case when l_partkey % 4 = 0 then cast(cast(l_quantity as int) * 1000 as string) || ' m, ' || cast(l_linenumber * 5 as string) || ' inch, ' || cast(l_suppkey % 25 as string) || ' inks' when l_partkey % 4 = 1 then cast(l_suppkey % 25 as string) || ' colours ' || cast(cast(l_quantity as int) as string) || ',500 meters no dots' when l_partkey % 4 = 2 then cast(l_linenumber * 40 as string) || '.5 in dots' else 'flat, ' || cast(l_suppkey % 25 as string) || ' screens' end"
KIND = "(select *, l_partkey % 4 as kind, l_suppkey % 25 as k from lineitem)"


@query("f1_parse_request", f"""
select inks, width_in, meters, dots, count(*) as n from (select case when kind <> 2 and k between 1 and 20 then k::int end as inks,
  case when kind = 0 and l_linenumber > 0 and l_linenumber * 5 <= 200 then l_linenumber * 5::double when kind = 2 and l_linenumber * 40 + 0.5 <= 200 then l_linenumber * 40 + 0.5::double end as width_in,
  case when kind = 0 then l_quantity::int * 1000::double when kind = 1 then l_quantity::int * 1000 + 500::double end as meters, case when kind = 1 then false when kind = 2 then true when kind = 3 then false end as dots from {KIND} q) z group by 1, 2, 3, 4""")
def _(spark, d):
    t = X.named(spark, d, "lineitem").selectExpr(f"{REQUEST} as t")
    return t.select(T.parse_request(F.col("t")).alias("r")).select("r.*").groupBy("inks", "width_in", "meters", "dots").agg(F.count("*").alias("n"))


@query("f2_settings_from_name", f"select k::int as name_inks, case when k between 1 and 20 then k::int end as inks, (l_linenumber * 5)::double as width_in, count(*) as n from {KIND} q group by 1, 2, 3")
def _(spark, d):
    t = X.named(spark, d, "lineitem").selectExpr("cast(l_suppkey % 25 as int) as name_inks", "'in/rose_' || cast(l_linenumber * 5 as string) || 'in_' || cast(l_suppkey % 25 as string) || 'inks.png' as f")
    t = t.select("name_inks", T.parse_request(T.settings_text(F.col("f"))).alias("r"))
    return t.select("name_inks", "r.inks", "r.width_in").groupBy("name_inks", "inks", "width_in").agg(F.count("*").alias("n"))


@query("f3_lookup_colour", """
select p_name as phrase, case split_part(p_name, ' ', 1) when 'red' then '#C8102E' when 'blue' then '#1F5FBF' when 'green' then '#2E8B3A' end as plain, count(*) as n from part group by 1, 2""")
def _(spark, d):
    t = X.named(spark, d, "part")
    return t.select(F.col("p_name").alias("phrase"), T.lookup_colour(F.split("p_name", " ")[0]).alias("plain")).groupBy("phrase", "plain").agg(F.count("*").alias("n"))


@query("f6_client_key", r"select c_custkey, lower(trim(regexp_replace('  ' || c_name || '   of ' || c_mktsegment || ' ', '\s+', ' ', 'g'))) as key from customer")
def _(spark, d):
    from ..operators.ledger import client_key

    return X.named(spark, d, "customer").select("c_custkey", client_key(F.concat(F.lit("  "), "c_name", F.lit("   of "), "c_mktsegment", F.lit(" "))).alias("key"))


@query("f7_money", r"""
with v as (select o_orderkey, round_even(o_totalprice, 0)::bigint::varchar as s from orders)
select o_orderkey, '₹' || case when length(s) <= 3 then s else reverse(regexp_replace(reverse(s[:length(s) - 3]), '(\d\d)(\d)', '\1,\2', 'g')) || ',' || s[length(s) - 2:] end as money  from v""")
def _(spark, d):
    t = X.named(spark, d, "orders")
    return t.select("o_orderkey", T.money(F.col("o_totalprice")).alias("money"))


@query("f8_ink_token", "select p_partkey, trim(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9]+', '-', 'g'), '-')[:32] as token from part")
def _(spark, d):
    return X.named(spark, d, "part").select("p_partkey", T.ink_token(F.concat("p_name", F.lit(" / "), "p_brand")).alias("token"))


@query("f9_letter", "select p_partkey, case when p_partkey < 26 then chr((65 + p_partkey)::int) when p_partkey < 702 then chr((65 + (p_partkey - 26) // 26)::int) || chr((65 + (p_partkey - 26) % 26)::int) else chr((65 + (p_partkey - 702) // 676)::int) || chr((65 + (p_partkey - 702) // 26 % 26)::int) || chr((65 + (p_partkey - 702) % 26)::int) end as letter from part")
def _(spark, d):
    return X.named(spark, d, "part").select("p_partkey", T.letter(F.col("p_partkey")).alias("letter"))


@query("f12_ago", """
select event_id, case when s < 3600 then (s // 60) || ' min ago' when s < 86400 then (s // 3600) || ' h ago' else (s // 86400) || ' days ago' end as ago, strftime(ts, '%Y-%m-%d') as day
from (select *, epoch(timestamp '2024-02-01')::bigint - floor(epoch(ts))::bigint as s from events) z""")
def _(spark, d):
    t = X.named(spark, d, "events").withColumn("s", F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return t.select("event_id", T.ago(F.col("s")).alias("ago"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("f13_report_columns", """select event_id, (props->>'$.k')::bigint as k, '{"k":' || (props->>'$.k') || ',"job":' || user_id || '}' as report from events""")
def _(spark, d):
    t = X.named(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return t.select("event_id", "p.k", F.to_json(F.struct(F.col("p.k").alias("k"), F.col("user_id").alias("job"))).alias("report"))


@query("s9_safe_cell", r"select conv_id, turn, case when left(t, 1) in ('=', '+', '-', '@') then '''' || t else t end as cell from (select conv_id, turn, case turn % 4 when 0 then '=' when 1 then '-' when 2 then '@' else '' end || role as t from conversations) z")
def _(spark, d):
    t = X.named(spark, d, "conversations").selectExpr("conv_id", "turn", "case turn % 4 when 0 then '=' when 1 then '-' when 2 then '@' else '' end || role as t")
    return t.select("conv_id", "turn", T.safe_cell(F.col("t")).alias("cell"))


@query("p11_print_geometry", """
select p_partkey, w, h, round(w / 300::double, 4) as at_300, round(w / 300::double * 25.4, 3) as mm, w * h > 70000000 as refused, round(w / (10 + p_size)::double, 2) as ppi
from (select *, (p_retailprice * 10)::bigint as w, p_size * 200 as h from part) z""")
def _(spark, d):
    t = X.named(spark, d, "part").selectExpr("*", "cast(round(p_retailprice * 10) as bigint) as w", "p_size * 200 as h")
    return t.selectExpr("p_partkey", "w", "h", "round(w / 300e0, 4) as at_300", "round(w / 300e0 * 25.4e0, 3) as mm", "w * h > 70000000 as refused", "round(w / cast(10 + p_size as double), 2) as ppi")


@query("p12_dot_rules", """
select l_orderkey as job, l_linenumber as line, l_quantity / 100 as mm, floor(pi() / 4 * power(l_quantity / 100 * 300 / 25.4, 2))::bigint as area, greatest(1, round_even(l_suppkey * 10 / l_quantity, 0))::bigint as pixels,
  case when l_quantity / 100 < 0.12 then 'too fine for most mesh' when l_quantity / 100 > 0.45 then 'pattern will show' else 'ok' end as verdict from lineitem""")
def _(spark, d):
    mm = F.col("l_quantity") / 100
    return X.named(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("line"), mm.alias("mm"), R.dot_area(mm, F.lit(300)).alias("area"), R.dot_pixels(F.col("l_quantity"), F.col("l_suppkey") * 10).alias("pixels"), R.dot_verdict(mm).alias("verdict"))


BAYER = "(0,0,0),(1,0,8),(2,0,2),(3,0,10),(0,1,12),(1,1,4),(2,1,14),(3,1,6),(0,2,3),(1,2,11),(2,2,1),(3,2,9),(0,3,15),(1,3,7),(2,3,13),(3,3,5)"


@query("p14_halftone_bayer", f"""
select d, count(*) filter (cp / 256.0 > (t + 0.5) / 16) as dots, count(*) as n from {X.CHARS} c join (values {BAYER}) b(bx, by_, t) on c.x % 4 = bx and c.y % 4 = by_ group by 1""")
def _(spark, d):
    grid = F.array(*[F.lit(int(v.split(",")[2])) for v in BAYER.strip("()").split("),(")])
    t = X.chars(spark, d).withColumn("t", F.get(grid, ((F.col("y") % 4) * 4 + F.col("x") % 4).cast("int")))
    return t.groupBy("d").agg(F.sum((F.col("cp") / 256.0 > (F.col("t") + 0.5) / 16).cast("long")).alias("dots"), F.count("*").alias("n"))


@query("p18_strategy", """
select l_suppkey as design, round(avg(l_discount * 2 * (l_suppkey % 3) / 2), 4) as gradient, (l_suppkey % 9 + 1)::int as inks, case when avg(l_discount * 2 * (l_suppkey % 3) / 2) < 0.08 then 'spot' when l_suppkey % 9 + 1 >= 4 then 'hybrid' else 'halftone' end as strategy from lineitem group by l_suppkey""")
def _(spark, d):
    t = X.named(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("design")).agg(F.avg(F.expr("l_discount * 2 * (l_suppkey % 3) / 2")).alias("g"))
    inks = (F.col("design") % 9 + 1).cast("int")
    return t.select("design", F.round("g", 4).alias("gradient"), inks.alias("inks"), R.recommend(F.col("g"), inks).alias("strategy"))
