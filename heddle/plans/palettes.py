"""Queries of the colour and palette jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, layers
from ..operators import palette as P
from ..operators import raster
from . import fixtures as X
from .registry import query

RGB = colour.packed()
COUNTS = f"(select d, {RGB} as rgb, count(*) as n from {X.PIXELS} px where a >= 128 group by 1, 2)"
UNPACKED = ", ".join(f"{e} as {c}" for c, e in colour.unpacked("rgb").items())
COLOURS = f"(select *, {UNPACKED} from {COUNTS} cn)"
LAB = layers.sql(COLOURS, colour.lab())
INKS_LAB = layers.sql(X.PALETTE_SQL, colour.lab("p", "pr", "pg", "pb"))
NEAREST = f"(select * from (select c.d, c.rgb, c.n, c.ll, c.aa, c.bb, p.ink, p.llp, p.aap, p.bbp, row_number() over (partition by c.d, c.rgb order by {colour.squared('', 'p')}, p.ink) as rn from {LAB} c, {INKS_LAB} p) z where rn = 1)"


@query("coverage_and_match", f"""
with m as (select d, ink, sum(n)::bigint as pixels, sum(n * de) / sum(n) as mean_de from {layers.sql(NEAREST, colour.de2000('', 'p'))} q group by 1, 2)
select d, ink, pixels, round(100 * pixels / sum(pixels) over (partition by d), 4) as coverage, round(mean_de, 4) as mean_de,
  round(100 * greatest(0, 1 - mean_de / 25), 4) as match, row_number() over (partition by d order by pixels desc, ink) as rank from m""")
def _(spark, d):
    return P.coverage_and_match(X.pixels(spark, d), X.palette(spark))


@query("a1_colour_counts", f"select d, rgb, n from {COUNTS} q")
def _(spark, d):
    return P.colour_counts(X.pixels(spark, d))


@query("a2_ink_count", f"select d, count(*) filter (n >= 0.001 * t)::bigint as inks from (select *, sum(n) over (partition by d) as t from {COUNTS} q) z group by 1")
def _(spark, d):
    return P.ink_count(P.colour_counts(X.pixels(spark, d)))


@query("a3_flat_palette", f"""
select d, count(*) filter (n / t >= 0.001)::bigint as kept, round(sum(case when n / t >= 0.001 then n else 0 end) / sum(n), 6) as share,
  count(*) filter (n / t >= 0.001) <= 32 and sum(case when n / t >= 0.001 then n else 0 end) / sum(n) > 0.97 as flat
from (select *, sum(n) over (partition by d) as t from {COUNTS} q) z group by 1""")
def _(spark, d):
    return P.flat_palette(P.colour_counts(X.pixels(spark, d)), 32)


COVERAGE = "(select d, ink, n, 100 * n / sum(n) over (partition by d) as of_inked, 100 * n / t as of_area from (select *, sum(n) over (partition by d) as t from (select d, ink, count(*) as n from {} lb group by 1, 2) q) z where ink >= 0)"


@query("a4_coverage", f"select d, ink, n, round(of_inked, 4) as of_inked, round(of_area, 4) as of_area, row_number() over (partition by d order by n desc, ink) as rank from {COVERAGE.format(X.LABELS)} c")
def _(spark, d):
    return P.coverage(X.labels(spark, d))


REF = f"(select l.d, l.x, l.y, coalesce(lag(l.ink) over (partition by l.d, l.y order by l.x), l.ink) as ink from {X.LABELS} l)"


def ref_labels(spark, d):
    """The labels moved one pixel to the right."""
    return raster.beside(X.labels(spark, d), "ink", {"w": (0, -1)}).selectExpr("d", "x", "y", "coalesce(w, ink) as ink")


@query("a15_coverage_difference", f"""
select d, round(sum(abs(coalesce(u, 0) - coalesce(v, 0))) / 2, 3) as difference from
(select coalesce(a.d, b.d) as d, a.u, b.v from (select d, ink, round(of_inked, 4) as u from {COVERAGE.format(X.LABELS)} c) a
 full join (select d, ink, round(of_inked, 4) as v from {COVERAGE.format(REF)} c) b on a.d = b.d and a.ink = b.ink) z group by 1""")
def _(spark, d):
    return P.coverage_difference(X.labels(spark, d), ref_labels(spark, d))


TOP = f"(select * from (select *, row_number() over (partition by d order by n desc, rgb) - 1 as ink from {COUNTS} q) z where ink < 8)"
TOP_LAB = layers.sql(f"(select *, {UNPACKED} from {TOP} tp)", colour.lab())
PAIR = ", ".join(f"a.{c} as {c}i, b.{c} as {c}j" for c in ("ink", "rgb", "n", "ll", "aa", "bb"))
PAIRS = layers.sql(f"(select a.d, {PAIR} from {TOP_LAB} a join {TOP_LAB} b on a.d = b.d and a.ink < b.ink)", colour.de2000("i", "j"))


def top_inks(spark, d):
    return P.palette_of(P.colour_counts(X.pixels(spark, d)), 8)


@query("p1_rgb_to_lab", f"select distinct rgb, round(ll, 4) as ll, round(aa, 4) as aa, round(bb, 4) as bb from {LAB} q")
def _(spark, d):
    t = P.with_lab(P.colour_counts(X.pixels(spark, d)).select("rgb").distinct())
    return t.selectExpr("rgb", "round(ll, 4) as ll", "round(aa, 4) as aa", "round(bb, 4) as bb")


@query("p2_delta_e2000", f"select d, inki as i, inkj as j, round(de, 4) as de from {PAIRS} q")
def _(spark, d):
    return P.palette_pairs(top_inks(spark, d)).selectExpr("d", "inki as i", "inkj as j", "round(de, 4) as de")


@query("p3_delta_e76", f"select d, inki as i, inkj as j, round({colour.de76('i', 'j')}, 4) as de from {PAIRS} q")
def _(spark, d):
    return P.palette_pairs(top_inks(spark, d)).selectExpr("d", "inki as i", "inkj as j", f"round({colour.de76('i', 'j')}, 4) as de")


@query("p4_hex_and_packed", f"select distinct rgb, r, g, b, printf('#%02X%02X%02X', r, g, b) as hex from {COLOURS} q")
def _(spark, d):
    t = P.colour_counts(X.pixels(spark, d)).select("rgb").distinct().selectExpr("rgb", *[f"{e} as {c}" for c, e in colour.unpacked("rgb").items()])
    return t.selectExpr("rgb", "r", "g", "b", f"{colour.hex_digits()} as hex")


@query("p5_luminance", f"select distinct rgb, round((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255, 6) as luminance, round((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255, 6) < 0.5 as dark from {COLOURS} q")
def _(spark, d):
    t = P.colour_counts(X.pixels(spark, d)).select("rgb").distinct().selectExpr("rgb", *[f"{e} as {c}" for c, e in colour.unpacked("rgb").items()])
    return t.selectExpr("rgb", f"round({colour.luminance()}, 6) as luminance").selectExpr("*", "luminance < 0.5 as dark")


@query("p9_mix", f"select distinct rgb, cast(round(r + (255 - r) * 0.45::double) as int) as light_r, cast(round(g + (255 - g) * 0.45::double) as int) as light_g, cast(round(b - b * 0.4::double) as int) as dark_b from {COLOURS} q")
def _(spark, d):
    t = P.colour_counts(X.pixels(spark, d)).select("rgb").distinct().selectExpr("rgb", *[f"{e} as {c}" for c, e in colour.unpacked("rgb").items()])
    return t.selectExpr("rgb", f"{colour.mixed('r', 255, 0.45)} as light_r", f"{colour.mixed('g', 255, 0.45)} as light_g", f"{colour.mixed('b', 0, 0.4)} as dark_b")


@query("j1_nearest_ink", f"select d, rgb, n, ink from {NEAREST} q")
def _(spark, d):
    return P.nearest_ink(P.colour_counts(X.pixels(spark, d)), X.palette(spark)).select("d", "rgb", "n", "ink")


SHELF = "(select key, name, sr, sg, sb from (select *, row_number() over (partition by sr, sg, sb order by name, key) as k from (select p_partkey as key, p_name as name, (p_partkey * 7) % 256 as sr, (p_partkey * 13) % 256 as sg, (p_partkey * 29) % 256 as sb from part) a) b where k = 1)"


def shelf(spark, d):
    """The ink shelf: one ink a colour, of the lowest name and key. Colours repeat after 256 parts, so it stays as small, however long the table."""
    part = X.named(spark, d, "part").selectExpr("p_partkey as key", "p_name as name", "(p_partkey * 7) % 256 as sr", "(p_partkey * 13) % 256 as sg", "(p_partkey * 29) % 256 as sb")
    return part.groupBy("sr", "sg", "sb").agg(F.min(F.struct("name", "key")).alias("m")).select("m.key", "m.name", "sr", "sg", "sb")


@query("j2_match_shelf", f"""
with c as (select distinct rgb, ll, aa, bb from {TOP_LAB} q), s as materialized (select * from {layers.sql(SHELF, colour.lab('s', 'sr', 'sg', 'sb'))} q),
m as materialized (select rgb, name, key, de, row_number() over (partition by rgb order by round(de, 6), name, key) as rn from {layers.sql('(select * from c, s)', colour.de2000('', 's'))} q)
select t.d, t.ink, t.rgb, m.name as shelf_name, round(m.de, 4) as de, case when m.de <= 1 then 'same' when m.de <= 5 then 'close' else 'far' end as tone
from {TOP} t join m on m.rgb = t.rgb and m.rn = 1""")
def _(spark, d):
    return P.match_shelf(top_inks(spark, d), shelf(spark, d))


@query("j8_similar_inks", f"""
select d, rank, case when ni >= nj then inki else inkj end as keep, case when ni >= nj then inkj else inki end as drop, round(de, 4) as de
from (select *, row_number() over (partition by d order by round(de, 6), inki, inkj) as rank from {PAIRS} q where de < 25) z where rank <= 3""")
def _(spark, d):
    return P.similar_inks(top_inks(spark, d), 25.0)


@query("k7_small_inks", f"""
with e as materialized (select d, inki, inkj, de from {PAIRS} q),
near as (select d, ink, min(de) as extra from (select d, inki as ink, de from e union all select d, inkj, de from e) z group by 1, 2)
select t.d, t.ink, round(coverage, 4) as coverage, round(extra, 4) as extra, round(extra, 6) >= 5 as kept
from (select d, ink, 100 * n / sum(n) over (partition by d) as coverage from {TOP} q) t join near on near.d = t.d and near.ink = t.ink where coverage < 10""")
def _(spark, d):
    return P.small_inks(top_inks(spark, d), 10.0)


@query("k9_merge_stray", f"""
with c as (select *, n >= sum(n) over (partition by d) * 0.0005 as big from {COLOURS} q)
select d, rgb, n, to_rgb from (select s.d, s.rgb, s.n, b.rgb as to_rgb, row_number() over (partition by s.d, s.rgb order by (s.r - b.r) * (s.r - b.r) + (s.g - b.g) * (s.g - b.g) + (s.b - b.b) * (s.b - b.b), b.rgb) as rn
from c s join c b on s.d = b.d and not s.big and b.big) z where rn = 1""")
def _(spark, d):
    return P.merge_stray(P.colour_counts(X.pixels(spark, d)))


@query("k22_press_order", f"""
select d, ink, place, lpad(place::varchar, 2, '0') || '_' || printf('%02X%02X%02X', r, g, b) as stem
from (select *, row_number() over (partition by d order by ll desc, ink) as place from {TOP_LAB} q) z""")
def _(spark, d):
    t = top_inks(spark, d).selectExpr("d", "ink", *[f"{e} as p{c}" for c, e in colour.unpacked("rgb").items()])
    return P.press_order(t)


@query("k2_lloyd_step", f"""
with c as (select rgb, sum(n) as n, any_value(ll) as ll, any_value(aa) as aa, any_value(bb) as bb from {LAB} q group by 1),
m as (select *, row_number() over (partition by rgb order by d2, ink) as rn from (select c.*, p.ink, {colour.squared('', 'p')} as d2 from c, {INKS_LAB} p) z)
select ink, sum(n)::bigint as n, round(sum(n * ll) / sum(n), 4) as ll, round(sum(n * aa) / sum(n), 4) as aa, round(sum(n * bb) / sum(n), 4) as bb from m where rn = 1 group by 1""")
def _(spark, d):
    points = P.colour_counts(X.pixels(spark, d)).groupBy("rgb").agg(F.sum("n").alias("n"))
    return P.lloyd_step(points, X.palette(spark))
