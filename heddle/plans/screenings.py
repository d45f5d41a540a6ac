"""Queries of the screen jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, layers
from ..operators import palette as P
from ..operators import score as C
from ..operators import screens as S
from . import fixtures as X
from .palettes import COUNTS, LAB, NEAREST, REF, TOP, TOP_LAB, ref_labels, shelf, top_inks
from .registry import query

SOFT = f"(select d, x, y, unnest(case when cp between 97 and 122 then [1, 2] else [0] end) as screen, case when cp = 32 then 255 else cp end as alpha from {X.CHARS} c)"


def soft_screens(spark, d):
    return X.chars(spark, d).selectExpr("d", "x", "y", "explode(case when cp between 97 and 122 then array(1, 2) else array(0) end) as screen", "case when cp = 32 then 255 else cp end as alpha")


@query("k15_separate", f"select d, ink as screen, count(*) as pixels from {X.LABELS} l where ink >= 0 group by 1, 2")
def _(spark, d):
    return S.separate(X.labels(spark, d)).groupBy("d", "screen").agg(F.count("*").alias("pixels"))


@query("a5_screen_coverage", f"select s.d, s.screen, round(100 * sum(alpha) / (255 * any_value(area)), 4) as coverage from {SOFT} s join (select d, count(*) as area from {X.CHARS} c group by 1) a on a.d = s.d group by 1, 2")
def _(spark, d):
    return S.screen_coverage(soft_screens(spark, d), X.chars(spark, d).groupBy("d").agg(F.count("*").alias("area")))


@query("a7_tint_report", f"""
select d, count(*) filter (soft > 0) as tinted, count(*) as screens, round(100 * sum(soft) / sum(n), 4) as soft_pct, round(100 * sum(below) / sum(n), 4) as below_pct
from (select d, screen, count(*) as n, count(*) filter (alpha < 255) as soft, count(*) filter (alpha < 128) as below from {SOFT} s where alpha > 0 group by 1, 2) q group by 1""")
def _(spark, d):
    return S.tint_report(soft_screens(spark, d))


CELLS = f"(select d, x, y, count(*) as k, bool_and(alpha = 255) as hard from {SOFT} s where alpha > 0 group by 1, 2, 3)"


@query("a8_overlap_a9_exclusive", f"select d, round(100 * avg((k > 1)::int::double), 4) as overlap, bool_and(hard) and max(k) = 1 as exclusive from {CELLS} q group by 1")
def _(spark, d):
    return S.overlap(soft_screens(spark, d))


@query("k18_proof", f"""
with a as (select d, x, y, min(alpha) as alpha, count(*) as k from {SOFT} s where alpha > 0 group by 1, 2, 3),
p as (select d, case when k = 1 then floor(((255 - alpha) * 255 + alpha * 20) / 255::double + 0.5)::int else floor(((255 - alpha) * floor(((255 - alpha) * 255 + alpha * 200) / 255::double + 0.5)::int + alpha * 31) / 255::double + 0.5)::int end as r from a)
select d, r, count(*) as n from p group by 1, 2""")
def _(spark, d):
    inks = spark.createDataFrame([(0, 1, 20), (1, 2, 200), (2, 3, 31)], "screen int, place int, r int")
    return S.proof(soft_screens(spark, d), inks).groupBy("d", "r").agg(F.count("*").alias("n"))


@query("k20_stack_steps", f"select d, screen, until, count(*) as pixels from (select d, screen, lead(screen) over (partition by d, x, y order by screen) as until from {SOFT} s where alpha > 0) q group by 1, 2, 3")
def _(spark, d):
    return S.stack_steps(soft_screens(spark, d))


@query("k21_verify_package", f"""
select coalesce(f.d, s.d) as d, count(*) as pixels, count(*) filter (s.ink is null) as gaps, count(*) filter (f.ink is null) as extra, count(*) filter (f.ink <> s.ink) as wrong,
  count(*) filter (s.ink is null or f.ink is null or f.ink <> s.ink) = 0 as ok
from (select * from {X.LABELS} l where ink >= 0) f full join (select * from {REF} r where ink >= 0) s on f.d = s.d and f.x = s.x and f.y = s.y group by 1""")
def _(spark, d):
    return S.verify_package(X.labels(spark, d), S.separate(ref_labels(spark, d)))


@query("a17_design_hash", f"select d, count(*) as n, sum((x * 31 + y * 17 + 7)::bigint * (r * 65536 + g * 256 + b) % 1000003)::bigint as h1, sum((x + 64 * y) % 8191 * (r + 3 * g + 7 * b))::bigint as h2 from {X.PIXELS} p group by 1")
def _(spark, d):
    p = X.pixels(spark, d).selectExpr("d", "cast(x as bigint) as x", "cast(y as bigint) as y", "r", "g", "b")
    return S.design_hash(p)


@query("j7_repaint", f"select d, case ink when 1 then 2 when 2 then 3 else ink end as ink, count(*) as n from {X.LABELS} l group by 1, 2")
def _(spark, d):
    mapping = spark.createDataFrame([(1, 2), (2, 3)], "ink int, to int")
    return S.repaint(X.labels(spark, d).groupBy("d", "ink").agg(F.count("*").alias("n")), mapping)


@query("a21_strip_coverage", f"select d, x * 8 // (w + 1) as strip, round(sum(r)::bigint / (255.0::double * count(*)), 4) as tone from (select *, max(x) over (partition by d) as w from {X.PIXELS} p) q group by 1, 2")
def _(spark, d):
    return S.strip_coverage(X.pixels(spark, d))


@query("a12_palette_match", f"select d, round(100 * greatest(0, 1 - sum(n * de) / sum(n) / 25), 4) as match from {layers.sql(NEAREST, colour.de2000('', 'p'))} q group by 1")
def _(spark, d):
    return C.palette_accuracy(P.colour_counts(X.pixels(spark, d)), X.palette(spark))


SOFT_LAB = layers.sql(f"(select p.d, p.r, p.g, p.b, q.r as u, q.g as v, q.b as w, count(*) as n from {X.PIXELS} p join {X.PIXELS_SOFT} q on p.d = q.d and p.x = q.x and p.y = q.y where p.a >= 128 and q.a >= 128 group by all)", [*colour.lab("p"), *colour.lab("q", "u", "v", "w"), *colour.de2000("p", "q")])


@query("a12_pixel_match", f"select d, round(sum(n * de) / sum(n), 4) as mean_de, round(100 * greatest(0, 1 - sum(n * de) / sum(n) / 25), 4) as match from {SOFT_LAB} q group by 1")
def _(spark, d):
    return C.pixel_match(X.pixels(spark, d), X.pixels(spark, d, soft=True))


@query("j4_exact_ink", f"select c.d, c.rgb, c.n, coalesce(t.ink, -1) as ink from {COUNTS} c left join {TOP} t on t.d = c.d and t.rgb = c.rgb")
def _(spark, d):
    counts = P.colour_counts(X.pixels(spark, d))
    return counts.join(P.palette_of(counts, 8).select("d", "rgb", "ink"), ["d", "rgb"], "left").select("d", "rgb", "n", F.coalesce("ink", F.lit(-1)).alias("ink"))


@query("j5_dropped_colours", f"""
with t as materialized (select * from {TOP_LAB} q), c as (select * from {LAB} c where not exists (select 1 from t where t.d = c.d and t.rgb = c.rgb)),
m as (select c.d, c.rgb, c.n, t.ink, row_number() over (partition by c.d, c.rgb order by round((c.ll - t.ll) * (c.ll - t.ll) + (c.aa - t.aa) * (c.aa - t.aa) + (c.bb - t.bb) * (c.bb - t.bb), 9), t.ink) as k from c join t on t.d = c.d)
select d, rgb, n, ink as to_ink from m where k = 1""")
def _(spark, d):
    counts = P.colour_counts(X.pixels(spark, d))
    inks = P.palette_of(counts, 8).selectExpr("d", "cast(ink as int) as ink", *[f"{e} as p{c}" for c, e in colour.unpacked("rgb").items()])
    return C.dropped_colours(counts, inks)


@query("j3_swap_plan")
def _(spark, d):
    """Shelf inks of ``part`` that can stand in for the inks of every design, within a difference of 5, one for one."""
    return S.swap_plan(P.shelf_pairs(top_inks(spark, d), shelf(spark, d), 5.0).select("d", "ink", F.col("key").alias("shelf"), F.round("de", 6).alias("de")))
