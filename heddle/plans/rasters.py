"""Queries of the neighbourhood and region jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import palette as P
from ..operators import raster as R
from ..operators import score as C
from ..operators.packing import matched
from . import fixtures as X
from .palettes import REF, ref_labels
from .registry import query

R_, C_ = "(partition by d, y order by x)", "(partition by d, x order by y)"


def around(source: str, value: str) -> str:
    return f"""(select *, lag(w) over {C_} as nw, lag({value}) over {C_} as n, lag(e) over {C_} as ne, lead(w) over {C_} as sw, lead({value}) over {C_} as s, lead(e) over {C_} as se
from (select *, lag({value}) over {R_} as w, lead({value}) over {R_} as e from {source} a0) a1)"""


NEAR = around(X.LABELS, "ink")
SAME = " + ".join(f"coalesce((k.{n} = k.ink)::int, 0)" for n in R.AROUND)


@query("n8_isolated_dots", f"select d, ink, count(*) as dots from {NEAR} k where ink >= 0 and {SAME} = 0 group by 1, 2")
def _(spark, d):
    return R.isolated_dots(X.labels(spark, d))


@query("n6_dense", f"select d, count(*) as kept from {NEAR} k where ink = 3 and {SAME} >= 2 group by 1")
def _(spark, d):
    return R.dense(X.labels(spark, d), 3)


@query("n12_contacts", f"""
select d, least(ink, o) as a, greatest(ink, o) as b, count(*) as n from (select d, ink, unnest([r, q]) as o from (select *, lead(ink) over {R_} as r, lead(ink) over {C_} as q from {X.LABELS} a) z) y
where ink >= 0 and o >= 0 and ink <> o group by 1, 2, 3""")
def _(spark, d):
    return R.contacts(X.labels(spark, d))


@query("a14_edge_share", f"select d, round(100 * avg((coalesce(ink <> l, false) or coalesce(ink <> u, false))::int::double), 4) as edge_share from (select *, lag(ink) over {R_} as l, lag(ink) over {C_} as u from {X.LABELS} a) z group by 1")
def _(spark, d):
    return R.edge_share(X.labels(spark, d))


@query("n5_mode_filter", f"""
select d, ink, m as mode, count(*) as n from (select d, x, y, ink, (select v from (select v, count(*) as c from (select unnest([ink, {', '.join(R.AROUND)}]) as v) u where v is not null group by 1) t order by c desc, v limit 1) as m from {NEAR} k) z group by 1, 2, 3""")
def _(spark, d):
    return R.mode_filter(X.labels(spark, d)).groupBy("d", "ink", "mode").agg(F.count("*").alias("n"))


@query("n4_median_filter", f"""
select d, r, median, count(*) as n from (select d, r, c[(len(c) + 1) // 2] as median from (select d, r, list_sort(list_filter([r, {', '.join(R.AROUND)}], lambda v: v is not null)) as c from {around(X.PIXELS, 'r')} k) z) y group by 1, 2, 3""")
def _(spark, d):
    return R.median_filter(X.pixels(spark, d)).groupBy("d", "r", "median").agg(F.count("*").alias("n"))


BOX = "rows between 2 preceding and 2 following"


@query("n2_local_range", f"""
select d, rng as range, count(*) as n from (select d, max(a) over (partition by d, x order by y {BOX}) - min(z) over (partition by d, x order by y {BOX}) as rng
from (select d, x, y, max(r) over (partition by d, y order by x {BOX}) as a, min(r) over (partition by d, y order by x {BOX}) as z from {X.PIXELS} p) q) w group by 1, 2""")
def _(spark, d):
    return R.local_range(X.pixels(spark, d)).groupBy("d", "range").agg(F.count("*").alias("n"))


@query("n3_box_blur", f"""
select d, round(avg(b), 4) as mean, round(max(b), 4) as top from (select d, avg(a) over (partition by d, x order by y rows between 1 preceding and 1 following) as b
from (select d, x, y, avg(r) over (partition by d, y order by x rows between 1 preceding and 1 following) as a from {X.PIXELS} p) q) w group by 1""")
def _(spark, d):
    return R.box_blur(X.pixels(spark, d)).groupBy("d").agg(F.round(F.avg("blur"), 4).alias("mean"), F.round(F.max("blur"), 4).alias("top"))


@query("n1_edge_mask", f"""
select d, count(*) filter (sqrt(gx * gx + gy * gy) > 6.2) as edges, count(*) as n from (select d, coalesce((lead(r) over {R_} - lag(r) over {R_}) * 0.5::double, 0) as gx, coalesce((lead(r) over {C_} - lag(r) over {C_}) * 0.5::double, 0) as gy from {X.PIXELS} p) q group by 1""")
def _(spark, d):
    return R.gradient(X.pixels(spark, d)).groupBy("d").agg(F.sum((F.col("gradient") > 6.2).cast("long")).alias("edges"), F.count("*").alias("n"))


def mask_box(source: str, pick: str) -> str:
    around_ = "rows between 1 preceding and 1 following"
    return f"(select d, x, y, {pick}(a) over (partition by d, x order by y {around_}) as m from (select d, x, y, {pick}(m) over (partition by d, y order by x {around_}) as a from {source} q) w)"


MASK = f"(select d, x, y, (ink = 2)::int as m from {X.LABELS} l)"
ERODED, DILATED = mask_box(MASK, "min"), mask_box(MASK, "max")

for op, out in (("erode", ERODED), ("dilate", DILATED), ("open", mask_box(ERODED, "max")), ("close", mask_box(DILATED, "min"))):

    @query(f"n13_{op}", f"select b.d, sum(b.m)::bigint as before, sum(o.m)::bigint as after from {MASK} b join {out} o on o.d = b.d and o.x = b.x and o.y = b.y group by 1")
    def _(spark, d, op=op):
        return R.morph(X.labels(spark, d), 2, op).groupBy("d").agg(F.sum("m").alias("before"), F.sum("out").alias("after"))


def cross(c: str, none: int) -> str:
    return ", ".join(f"coalesce({f}({c}) over {w}, {none})" for f in ("lag", "lead") for w in (R_, C_))


@query("k16_underbase", f"""
select d, sum(u)::bigint as inked, sum(greatest(e, u * (1 - r)))::bigint as white from (select *, greatest(e, {cross('e', 0)}) as r from (select *, least(u, {cross('u', 1)}) as e from (select d, x, y, (ink >= 0)::int as u from {X.LABELS} l) a) b) c group by 1""")
def _(spark, d):
    return R.underbase(X.labels(spark, d)).groupBy("d").agg(F.sum("u").alias("inked"), F.sum("white").alias("white"))


@query("k17_trap", f"""
with p as (select d, x, y, case ink when 0 then 1 when 3 then 2 when 1 then 3 when 2 then 4 end as place from {X.LABELS} l),
s as (select d, x, y, place, unnest([lag(place) over {R_}, lead(place) over {R_}, lag(place) over {C_}, lead(place) over {C_}]) as under from p)
select d, under, place, count(distinct (x, y)) as pixels from s where under < place group by 1, 2, 3""")
def _(spark, d):
    rank = spark.createDataFrame([(0, 1), (3, 2), (1, 3), (2, 4)], "ink int, place int")
    return R.trap(X.labels(spark, d), rank)


GAP = "abs({0}.r - {1}.r) + abs({0}.g - {1}.g) + abs({0}.b - {1}.b)"


@query("n18_seamless_axis", f"""
with p as materialized (select d, x, y, r, g, b, max(x) over (partition by d) as w from {X.PIXELS} px), q as (select * from p where w >= 7),
i as (select a.d, avg({GAP.format('a', 'b')}) as inner_ from q a join q b on a.d = b.d and a.y = b.y and b.x = a.x + 1 group by 1),
s as (select a.d, avg({GAP.format('a', 'z')}) as seam, avg({GAP.format('a', 'm')}) as far from q a join q z on z.d = a.d and z.y = a.y and z.x = a.w and a.x = 0 join q m on m.d = a.d and m.y = a.y and m.x = (a.w + 1) // 2 group by 1)
select s.d, round(seam, 4) as seam, round(inner_, 4) as inner, round(far, 4) as far, (case when inner_ > 0 then seam <= 1.5 * inner_ else seam = 0 end) and (seam = 0 or seam <= 0.6 * far) as seamless from s join i on s.d = i.d""")
def _(spark, d):
    return R.seam_steps(X.pixels(spark, d))


SOFT_A = f"(select d, x, y, case when cp = 33 then 0 when cp = 44 then 90 when cp = 46 then 200 else 255 end as a from {X.CHARS} c)"


@query("a10_soft_edge_width", f"""
select d, count(*) filter (a > 0 and a < 255) as partial, count(*) filter (m and o) as edge, case when count(*) filter (m and o) > 0 then round(count(*) filter (a > 0 and a < 255) / count(*) filter (m and o), 4) else 0 end as soft_edge
from (select *, {' or '.join(f'not coalesce({f}(m) over {w}, true)' for f in ('lag', 'lead') for w in (R_, C_))} as o from (select *, a >= 128 as m from {SOFT_A} q) z) y group by 1""")
def _(spark, d):
    return R.soft_edge(X.chars(spark, d).selectExpr("d", "x", "y", "case when cp = 33 then 0 when cp = 44 then 90 when cp = 46 then 200 else 255 end as a"))


RUNS = f"(select d, ink, y, min(x) as x0, max(x) as x1 from (select *, x - row_number() over (partition by d, y, ink order by x) as g from {X.LABELS} l where ink >= 0) z group by d, ink, y, g)"


@query("n14_runs", f"select d, ink, count(*) as runs, sum(x1 - x0 + 1)::bigint as pixels, max(x1 - x0 + 1) as longest from {RUNS} r group by 1, 2")
def _(spark, d):
    return R.runs(X.labels(spark, d)).groupBy("d", "ink").agg(F.count("*").alias("runs"), F.sum(F.expr("x1 - x0 + 1")).alias("pixels"), F.max(F.expr("x1 - x0 + 1")).alias("longest"))


JOINED = f"(select l.d, l.x, l.y, l.ink as a, r.ink as b from {X.LABELS} l join {REF} r on l.d = r.d and l.x = r.x and l.y = r.y)"


@query("a13_agreement", f"select d, round(100 * avg((a = b)::int::double), 4) as agreement from {JOINED} q group by 1")
def _(spark, d):
    """Both rasters are in the fixed inks, so each ink's nearest truth colour is its own."""
    labels = X.labels(spark, d)
    inks = labels.select("d").distinct().crossJoin(F.broadcast(X.palette(spark)))
    return C.agreement(labels, inks.selectExpr("d", "ink", "pr * 65536 + pg * 256 + pb as rgb"), ref_labels(spark, d), inks)


@query("j6_colour_map", f"select d, a, case when count(distinct b) = 1 then min(b) end as b, count(distinct b) as ways from {JOINED} q group by 1, 2")
def _(spark, d):
    a, b = X.labels(spark, d), ref_labels(spark, d).withColumnRenamed("ink", "b")
    t = matched(a, b).groupBy("d", F.col("ink").alias("a")).agg(F.count_distinct("b").alias("ways"), F.min("b").alias("_m"))
    return t.select("d", "a", F.when(F.col("ways") == 1, F.col("_m")).alias("b"), "ways")


@query("a22_reconstruction", f"""
with z as (select p.d, abs(p.r - q.r) as r, abs(p.g - q.g) as g, abs(p.b - q.b) as b from {X.PIXELS} p join {X.PIXELS_SOFT} q on p.d = q.d and p.x = q.x and p.y = q.y), t as (select d, avg(r) as mr, avg(g) as mg, avg(b) as mb, sqrt(avg((r * r + g * g + b * b)::double) / 3) as rmse from z group by 1)
select d, round((mr + mg + mb) / 3, 4) as mae, round(rmse, 4) as rmse, round(20 * log10(255 / greatest(rmse, 1e-8)), 3) as psnr_db, round(mr, 4) as mae_r, round(mg, 4) as mae_g, round(mb, 4) as mae_b from t""")
def _(spark, d):
    return C.reconstruction(X.pixels(spark, d), X.pixels(spark, d, soft=True))


@query("a6_ground_edge_share", f"""
with l as materialized (select *, max(x) over (partition by d) as w, max(y) over (partition by d) as h from {X.LABELS} q), t as (select d, ink, count(*) filter (x = 0 or y = 0 or x = w or y = h) as ring, count(*) as n from l group by 1, 2)
select d, ink, ring, round(100 * ring / sum(ring) over (partition by d), 4) as share, round(100 * n / sum(n) over (partition by d), 4) as coverage from t""")
def _(spark, d):
    return C.ring_shares(X.labels(spark, d))


@query("a6_ground_suggestion", f"""
with l as materialized (select *, max(x) over (partition by d) as w, max(y) over (partition by d) as h from {X.LABELS} q), t as (select d, ink, count(*) filter (x = 0 or y = 0 or x = w or y = h) as ring, count(*) as n from l group by 1, 2),
s as (select d, ink, round(100 * ring / sum(ring) over (partition by d), 4) as share, round(100 * n / sum(n) over (partition by d), 4) as cover from t)
select d, ink, ink = 0 as matches from (select *, row_number() over (partition by d order by share desc, ink) as k from s where ink >= 0 and share >= 40 and cover >= 20) z where k = 1""")
def _(spark, d):
    """The ground of each design on white cloth; of the fixed inks only ink 0 is white."""
    inks = X.palette(spark).selectExpr("ink", "pr as r", "pg as g", "pb as b")
    return C.ground_suggestion(C.ring_shares(X.labels(spark, d)), inks)


__all__ = ["P"]
