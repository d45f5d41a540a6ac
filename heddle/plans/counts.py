"""Queries of image summaries, tiles, halftones, shapes and pluggable methods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import colour, layers
from ..functions import print_rules as rules
from ..operators import detail as D
from ..operators import methods as M
from ..operators import palette as P
from ..operators import raster as R
from ..operators import score as C
from ..operators import screens as S
from ..operators.packing import matched
from . import fixtures as X
from .ledgers import TRIALS
from .palettes import COUNTS, NEAREST, REF, TOP, TOP_LAB, ref_labels, top_inks
from .rasters import C_, R_, RUNS
from .registry import query

LUM = colour.luminance()


@query("a18_image_summary", f"""
with p as (select d, x, y, {colour.packed()} as rgb, {LUM} as lum from {X.PIXELS} q), s as (select *, abs(lead(lum) over {R_} - lum) as sx, abs(lead(lum) over {C_} - lum) as sy from p),
t as (select d, max(x) + 1 as width, max(y) + 1 as height, count(distinct rgb) as colours, avg(lum) as m, stddev_pop(lum) as s, coalesce(avg(sx), 0) + coalesce(avg(sy), 0) as step from s group by 1)
select d, width, height, colours, round(m, 4) as mean_lum, round(s, 4) as std_lum, round(least(1, 0.65::double * least(1, step * 8) + 0.35::double * s), 4) as gradient, round(least(1, step * 2), 4) as edges,
  concat_ws(',', case when least(width, height) < 256 then 'small' end, case when colours > 50000 then 'many_colours' end, case when s > 0.22 then 'broad_tones' end, case when width::bigint * height > 12000000 then 'large' end) as warnings from t""")
def _(spark, d):
    return C.image_summary(X.pixels(spark, d))


@query("a19_design_dna", f"""
with l as (select *, max(x) over (partition by d, y) as w from {X.LABELS} q), m as (select a.d, avg((a.ink = b.ink)::int::double) as sym from l a join l b on a.d = b.d and a.y = b.y and b.x = a.w - a.x group by 1),
c as (select d, avg((ink > 0)::int::double) as density from l group by 1)
select c.d, round(density, 4) as density, round(1 - density, 4) as negative_space, round(sym, 4) as symmetry, case when sym > 0.6 then 'high' when sym > 0.4 then 'medium' else 'low' end as band from c join m on m.d = c.d""")
def _(spark, d):
    t = R.mirrored(X.labels(spark, d))
    out = t.where("other is not null").groupBy("d").agg(F.avg((F.col("ink") > 0).cast("double")).alias("p"), F.avg((F.col("ink") == F.col("other")).cast("double")).alias("s"))
    return out.select("d", F.round("p", 4).alias("density"), F.round(1 - F.col("p"), 4).alias("negative_space"), F.round("s", 4).alias("symmetry"), F.when(F.col("s") > 0.6, "high").when(F.col("s") > 0.4, "medium").otherwise("low").alias("band"))


@query("a20_tone_report", f"select d, round(100 * avg((cp <> 32)::int::double), 4) as ink_pct, round(100 * avg(case when cp = 32 then (r > 200)::int::double end), 4) as stray_pct, round(quantile_cont(r, 0.99), 3) as p99 from {X.PIXELS} p group by 1")
def _(spark, d):
    flat = F.when(F.col("cp") == 32, (F.col("r") > 200).cast("double"))
    return X.pixels(spark, d).groupBy("d").agg(F.round(100 * F.avg((F.col("cp") != 32).cast("double")), 4).alias("ink_pct"), F.round(100 * F.avg(flat), 4).alias("stray_pct"), F.round(F.percentile("r", F.lit(0.99)), 3).alias("p99"))


@query("a23_pure_share", f"select d, ink, sum(n)::bigint as pixels, round(sum(case when sqrt(d2) <= 5 then n else 0 end) / sum(n), 4) as pure from (select *, {colour.squared('', 'p')} as d2 from {NEAREST} q) z group by 1, 2")
def _(spark, d):
    t = P.nearest_ink(P.colour_counts(X.pixels(spark, d)), X.palette(spark)).withColumn("d2", F.expr(colour.squared("", "p")))
    return t.groupBy("d", "ink").agg(F.sum("n").alias("pixels"), F.round(F.sum(F.when(F.sqrt("d2") <= 5, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("pure"))


@query("a11_ink_colours", f"""
with k as (select *, lag(ink) over {R_} = ink and lead(ink) over {R_} = ink and lag(ink) over {C_} = ink and lead(ink) over {C_} = ink as inner_, cp % 2 = 0 as kept from (select d, x, y, r, g, b, cp, {X.INK} as ink from {X.PIXELS} p) q)
select d, ink, count(*) as n, {', '.join(f"round(coalesce(avg(case when inner_ then {c} end), avg(case when kept then {c} end), avg({c})), 3) as {c}" for c in 'rgb')} from k where ink >= 0 group by 1, 2""")
def _(spark, d):
    return C.ink_colours(X.pixels(spark, d).selectExpr("d", "x", "y", "r", "g", "b", f"{X.INK} as ink", "cp % 2 = 0 as kept"), kept="kept")


@query("p6_to_8bit", f"select d, (cp * 257 * 3 // 257 // 3)::int as v, count(*) as n from {X.PIXELS} p where a >= 128 group by 1, 2")
def _(spark, d):
    return X.pixels(spark, d).where("a >= 128").selectExpr("d", "cast(round(cp * 257 / 257e0) as int) as v").groupBy("d", "v").agg(F.count("*").alias("n"))


@query("p7_p8_ink_tint_film", f"select d, count(*) filter (cp > 0) as ink_any, count(*) filter (cp >= 128) as ink, count(*) filter (cp between 1 and 254) as tint, sum(255 - cp)::bigint as film, sum(round_even(cp * 0.4::double, 0))::bigint as faded from {X.CHARS} c group by 1")
def _(spark, d):
    one = lambda t: F.sum(F.expr(t).cast("long"))
    return X.chars(spark, d).groupBy("d").agg(one("cp > 0").alias("ink_any"), one("cp >= 128").alias("ink"), one("cp between 1 and 254").alias("tint"), F.sum(255 - F.col("cp")).alias("film"), F.sum(F.rint(F.col("cp") * 0.4).cast("long")).alias("faded"))


@query("p10_crop_and_polygon", f"select d, count(*) filter (x between 8 and 40 and y between 1 and 6) as crop, count(*) filter (y * 4 <= x and x < 60 - y and y < 12) as inside from {X.CHARS} c group by 1")
def _(spark, d):
    # a triangle, by the even-odd rule as a sum over its edges
    triangle = [(0.0, 0.0), (60.0, 0.0), (48.0, 12.0)]
    return M.in_polygon(X.chars(spark, d), triangle).groupBy("d").agg(F.sum(((F.col("x").between(8, 40)) & F.col("y").between(1, 6)).cast("long")).alias("crop"), F.sum(F.col("inside").cast("long")).alias("inside"))


@query("p15_lay_repeat", f"select d, x + 64 * cx as px, count(*) as n, sum((y + 2 * (cx % 2)) * 256 + r)::bigint as mark from {X.PIXELS} p, (values (0), (1), (2)) v(cx) group by 1, 2")
def _(spark, d):
    laid = M.lay_repeat(X.pixels(spark, d).select("d", "x", "y", "r"), 64, 4, 3, 1, "half-drop")
    return laid.groupBy("d", "px").agg(F.count("*").alias("n"), F.sum(F.col("py") * 256 + F.col("r")).alias("mark"))


@query("p16_deshear", f"select d, round_even(x - 0.25::double * y, 0)::int as sx, count(*) as n, sum(y)::bigint as ys from {X.CHARS} c group by 1, 2")
def _(spark, d):
    return X.chars(spark, d).selectExpr("d", "cast(rint(x - 0.25e0 * y) as int) as sx", "y").groupBy("d", "sx").agg(F.count("*").alias("n"), F.sum("y").alias("ys"))


@query("p17_clean_ground", f"""
with b as (select d, r // 16 as bin, count(*) as n, median(r) as med from {X.PIXELS} p group by 1, 2), g as (select * from (select *, row_number() over (partition by d order by n desc, bin) as k from b) z where k = 1)
select p.d, g.med as ground, count(*) filter (abs(p.r - g.med) <= 20) as cleaned from {X.PIXELS} p join g on g.d = p.d group by 1, 2""")
def _(spark, d):
    t = X.pixels(spark, d).select("d", "r")
    bins = t.groupBy("d", F.floor(F.col("r") / 16).alias("bin")).agg(F.count("*").alias("n"), F.percentile("r", F.lit(0.5)).alias("med"))
    ground = bins.groupBy("d").agg(F.max_by("med", F.struct("n", -F.col("bin"))).alias("ground"))
    return t.join(ground, "d").groupBy("d", "ground").agg(F.sum((F.abs(F.col("r") - F.col("ground")) <= 20).cast("long")).alias("cleaned"))


@query("p14_halftone_am", f"select d, count(*) filter (cp / 256::double > 0.5 + 0.25 * (cos(2 * pi() * (x * cos(radians(22.5::double)) + y * sin(radians(22.5::double))) / 6) + cos(2 * pi() * (y * cos(radians(22.5::double)) - x * sin(radians(22.5::double))) / 6))) as dots from {X.CHARS} c group by 1")
def _(spark, d):
    rule = "cp / 256e0 > 0.5e0 + 0.25e0 * (cos(2 * pi() * (x * cos(radians(22.5e0)) + y * sin(radians(22.5e0))) / 6) + cos(2 * pi() * (y * cos(radians(22.5e0)) - x * sin(radians(22.5e0))) / 6))"
    return X.chars(spark, d).groupBy("d").agg(F.sum(F.expr(rule).cast("long")).alias("dots"))


@query("p14_halftone_fm", f"with n as (select d, cp, 0.06711056::double * x + 0.00583715::double * y as u from {X.CHARS} c), m as (select d, cp, 52.9829189::double * (u - floor(u)) as v from n) select d, count(*) filter (cp / 256::double > v - floor(v)) as dots from m group by 1")
def _(spark, d):
    t = X.chars(spark, d).selectExpr("d", "cp", "0.06711056e0 * x + 0.00583715e0 * y as u").selectExpr("d", "cp", "52.9829189e0 * (u - floor(u)) as v")
    return t.groupBy("d").agg(F.sum(F.expr("cp / 256e0 > v - floor(v)").cast("long")).alias("dots"))


PLATES = {"A": "underbase", "N": "spot", "R": "tonal"}


@query("p13_mesh_and_grams", """
select job, line, plate, case plate when 'underbase' then '110-156' when 'spot' then '156-230' else case when lpi <= 45 then '200-230' when lpi <= 55 then '230-280' else '305-355' end end as mesh,
  round_even(w / 300::double * 0.0254 * (h / 300::double * 0.0254) * greatest(0, least(1, cover)) * case plate when 'underbase' then 50 when 'spot' then 30 else 18 end * 100 * 10, 0) / 10 as grams
from (select l_orderkey as job, l_linenumber as line, case l_returnflag when 'A' then 'underbase' when 'N' then 'spot' else 'tonal' end as plate, 35 + l_linenumber * 5 as lpi, (l_quantity * 200)::int as w, (l_suppkey % 50 + 1) * 200 as h, l_discount * 12 as cover from lineitem) z""")
def _(spark, d):
    plate = F.element_at(F.create_map(*[F.lit(x) for pair in PLATES.items() for x in pair]), F.col("l_returnflag"))
    t = X.named(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("line"), plate.alias("plate"), F.expr("35 + l_linenumber * 5").alias("lpi"), F.expr("cast(round(l_quantity * 200) as int)").alias("w"), F.expr("(l_suppkey % 50 + 1) * 200").alias("h"), F.expr("l_discount * 12").alias("cover"))
    return t.select("job", "line", "plate", rules.mesh(F.col("plate"), F.col("lpi")).alias("mesh"), rules.ink_grams(F.col("w"), F.col("h"), F.lit(300), F.col("cover"), F.col("plate")).alias("grams"))


GAPS = " union all ".join(f"select a.d, '{n}' as side, sqrt(power((a.r - z.r) / 255::double, 2) + power((a.g - z.g) / 255::double, 2) + power((a.b - z.b) / 255::double, 2)) / sqrt(3::double) as g from p a join p z on a.d = z.d and a.{across} = z.{across} and a.{along} = 0 and z.{along} = z.{far} and z.{far} > 0" for n, along, across, far in (("h", "x", "y", "w"), ("v", "y", "x", "hh")))


@query("n19_seam_metrics", f"""
with p as materialized (select *, max(x) over (partition by d) as w, max(y) over (partition by d) as hh from {X.PIXELS} q), g as ({GAPS}), a as (select d, side, avg(g) as mean, quantile_cont(g, 0.95) as p95, max(g) as top from g group by 1, 2),
t as (select d.d, {', '.join(f"coalesce(max(case when side = '{n}' then {c} end), 0) as {n}_{c}" for n in 'hv' for c in ('mean', 'p95', 'top'))} from (select distinct d from p) d left join a on a.d = d.d group by 1)
select d, {', '.join(f'round({n}_{c}, 4) as {n}_{c}' for n in 'hv' for c in ('mean', 'p95', 'top'))}, round(greatest(h_mean, v_mean, h_p95 / 2, v_p95 / 2), 4) as score,
  h_mean < 0.035 and v_mean < 0.035 and h_p95 < 0.08 and v_p95 < 0.08 and h_top < 0.15 and v_top < 0.15 as seamless from t""")
def _(spark, d):
    return D.seam_metrics(X.pixels(spark, d))


@query("n24_alignment_score", f"""
with e as (select d, x, y, ink <> lag(ink) over {R_} as edge from {REF} r), l as (select d, x, y, max((ink = 0)::int) over (partition by d, y order by x rows between 3 preceding and 3 following) as a from {X.LABELS} q),
m as (select d, x, y, max(a) over (partition by d, x order by y rows between 3 preceding and 3 following) as near from l)
select m.d, count(*) as edges, round(avg(near), 4) as score from m join e on e.d = m.d and e.x = m.x and e.y = m.y and e.edge group by 1""")
def _(spark, d):
    near = M.near_mask(X.labels(spark, d).selectExpr("d", "x", "y", "cast(ink = 0 as int) as m"), 3)
    edges = R.beside(ref_labels(spark, d), "ink", {"w": (0, -1)}).where("ink != w").select("d", "x", "y")
    return matched(edges, near).groupBy("d").agg(F.count("*").alias("edges"), F.round(F.avg("near"), 4).alias("score"))


@query("n32_mask_boundary", f"""
select d, ink, sum(coalesce((lag_x <> ink)::int, 1) + coalesce((lead_x <> ink)::int, 1) + coalesce((lag_y <> ink)::int, 1) + coalesce((lead_y <> ink)::int, 1))::bigint as edges, count(*) as area
from (select *, lag(ink) over {R_} as lag_x, lead(ink) over {R_} as lead_x, lag(ink) over {C_} as lag_y, lead(ink) over {C_} as lead_y from {X.LABELS} l) z where ink >= 0 group by 1, 2""")
def _(spark, d):
    return M.boundary(X.labels(spark, d))


BLEND = f"(select a.d, a.ink as i, b.ink as j, c.ink as k, greatest(0, least(1, ((c.ll - a.ll) * (b.ll - a.ll) + (c.aa - a.aa) * (b.aa - a.aa) + (c.bb - a.bb) * (b.bb - a.bb)) / nullif(power(b.ll - a.ll, 2) + power(b.aa - a.aa, 2) + power(b.bb - a.bb, 2), 0))) as t, a.ll as l1, a.aa as a1, a.bb as b1, b.ll as l2, b.aa as a2, b.bb as b2, c.ll as l3, c.aa as a3, c.bb as b3 from {TOP_LAB} a join {TOP_LAB} b on a.d = b.d and a.ink < b.ink join {TOP_LAB} c on c.d = a.d and c.ink <> a.ink and c.ink <> b.ink)"


@query("k12_blend_inks", f"""
select d, i, j, k, round(t, 4) as t, round(gap, 4) as gap from (select *, sqrt(power(l3 - l1 - t * (l2 - l1), 2) + power(a3 - a1 - t * (a2 - a1), 2) + power(b3 - b1 - t * (b2 - b1), 2)) as gap from {BLEND} q) z where t between 0.2 and 0.8 and gap < 12""")
def _(spark, d):
    return M.blend_inks(P.with_lab(top_inks(spark, d)))


#: Colourways of a design: its inks as they are, and the same with the channels changed about.
WAYS = [(0, "r", "g", "b"), (1, "g", "b", "r"), (2, "b", "r", "g"), (3, "(255 - r)", "(255 - g)", "(255 - b)")]
WAY_SQL = " union all ".join(f"select d, {w} as way, ink, n, {p} as r, {q} as g, {s} as b from (select *, {', '.join(f'{e} as {c}' for c, e in colour.unpacked('rgb').items())} from {TOP} tp) t" for w, p, q, s in WAYS)


@query("k28_colourways", f"""
with w as materialized (select * from {layers.sql('(' + WAY_SQL + ')', colour.lab())} z), p as (select d, way, ink, row_number() over (partition by d, way order by ll desc, ink) as place from w),
s as (select d, way, count(*) as similar from {layers.sql('(select a.d, a.way, a.ll as lli, a.aa as aai, a.bb as bbi, b.ll as llj, b.aa as aaj, b.bb as bbj from w a join w b on a.d = b.d and a.way = b.way and a.ink < b.ink)', colour.de2000('i', 'j'))} q where de < 5 group by 1, 2)
select p.d, p.way, p.ink, p.place, coalesce(s.similar, 0) as similar from p left join s on s.d = p.d and s.way = p.way""")
def _(spark, d):
    """Colourways over each design's own inks: the press order of each, and how many pairs of inks look alike in it."""
    inks = top_inks(spark, d).selectExpr("*", *[f"{e} as {c}" for c, e in colour.unpacked("rgb").items()])
    ways = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), *[F.expr(e).cast("int").alias(c) for c, e in zip("rgb", es, strict=True)]) for w, *es in WAYS])).alias("w")
    return S.colourways(inks.select("d", "ink", "r", "g", "b", ways).select("d", "w.way", "ink", "w.r", "w.g", "w.b"))


NAME_ROWS = [(n, *(int(h[i : i + 2], 16) for i in (1, 3, 5))) for n, (h, _) in M.COLOURS.items()]
NAMES_SQL = layers.sql("(select row_number() over () as place, * from (values " + ", ".join(map(str, NAME_ROWS)) + ") v(name, sr, sg, sb))", colour.lab("s", "sr", "sg", "sb"))


@query("j9_colour_name", f"""
select rgb, name from (select c.rgb, s.name, row_number() over (partition by c.rgb order by round({colour.de76('', 's')}, 6), s.place) as k from (select distinct rgb, ll, aa, bb from {layers.sql('(select *, ' + ', '.join(f'{e} as {c}' for c, e in colour.unpacked('rgb').items()) + f' from {COUNTS} q)', colour.lab())} z) c, {NAMES_SQL} s) y where k = 1""")
def _(spark, d):
    names = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(NAME_ROWS)], "place int, name string, sr int, sg int, sb int")
    return M.colour_names(P.colour_counts(X.pixels(spark, d)).select("rgb").distinct(), names)


@query("u2_fills_judged_together", f"select design, name, match from (select *, row_number() over (partition by design order by match desc, name) as k from {TRIALS} q) z where k = 1")
def _(spark, d):
    t = X.named(spark, d, "orders").selectExpr("o_custkey as design", "case when o_orderpriority = '1-URGENT' then 'reduce' else o_orderpriority end as name", "round(o_totalprice % 100, 2) as match")
    return M.best_of(t)


@query("u1_methods_scored")
def _(spark, d):
    """Registered palette methods on every design's distinct colours, scored by their mean squared error."""
    counts = P.with_lab(P.colour_counts(X.pixels(spark, d))).select("d", "rgb", "n", "ll", "aa", "bb")
    return M.score_methods(counts, 6)


@query("u4_regions_of_rows", f"select d, ink, count(*) as boxes, max(x1 - x0 + 1) as widest from {RUNS} r group by 1, 2")
def _(spark, d):
    """One design gives many boxes: each ink's runs, unpacked from one array a design and row."""
    rows = R.runs(X.labels(spark, d)).groupBy("d", "y").agg(F.collect_list(F.struct("ink", "x0", "x1")).alias("boxes"))  # at most one run a pixel of the row
    boxes = rows.select("d", F.explode("boxes").alias("b")).select("d", "b.*")
    return boxes.groupBy("d", "ink").agg(F.count("*").alias("boxes"), F.max(F.expr("x1 - x0 + 1")).alias("widest"))
