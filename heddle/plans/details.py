"""Queries of the detail jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..functions import print_rules as rules
from ..operators import detail as D
from ..operators import palette as P
from ..operators import packing, raster, reduce
from ..operators.graph import cut
from . import fixtures as X
from .palettes import PAIRS, TOP, top_inks
from .rasters import NEAR, R_, SAME, around
from .registry import query
from .screenings import SOFT, soft_screens

FRAME = "(partition by d, {0} order by {1} rows between {2} preceding and {2} following)"
THIN = f"""(select d, x, y, (abs(r - b) > 8.5 and abs(r - b) > 0.3::double * g)::int as thin from (select *, avg(m) over {FRAME.format('x', 'y', 1)} as b, max(a) over {FRAME.format('x', 'y', 2)} - min(z) over {FRAME.format('x', 'y', 2)} as g
from (select d, x, y, r, avg(r) over {FRAME.format('y', 'x', 1)} as m, max(r) over {FRAME.format('y', 'x', 2)} as a, min(r) over {FRAME.format('y', 'x', 2)} as z from {X.PIXELS} p) q) w)"""


@query("n7_thin_features", f"select d, count(*) as n from {around(THIN, 'thin')} k where thin = 1 and {SAME.replace('k.ink', '1')} >= 2 group by 1")
def _(spark, d):
    return D.thin_features(X.pixels(spark, d)).groupBy("d").agg(F.count("*").alias("n"))


COUNTED = f"(select d, x, y, ink, {SAME} as same from {NEAR} k)"
PAIRED = around(f"(select d, x, y, ink, same, ink * 100 + same as cell from {COUNTED} c)", "cell")
NAMES = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


@query("n11_tiny_islands", f"""
with s as (select d, x, y, ink, list_transform([{', '.join(NAMES)}], lambda c: floor(c / 100)::int) as near from {PAIRED} p where ink >= 0 and (same = 0 or same = 1 and ({' or '.join(f'coalesce({n} = ink * 100 + 1, false)' for n in NAMES)}))),
v as (select d, x, y, ink, o, count(*) as n from (select d, x, y, ink, unnest(near) as o from s) z where o >= 0 and o <> ink group by 1, 2, 3, 4, 5),
b as (select d, x, y, ink, o as to_, row_number() over (partition by d, x, y order by n desc, o) as k from v)
select s.d, s.ink, b.to_ as "to", count(*) as n from s left join b on b.d = s.d and b.x = s.x and b.y = s.y and b.k = 1 group by 1, 2, 3""")
def _(spark, d):
    return D.tiny_islands(X.labels(spark, d)).groupBy("d", "ink", "to").agg(F.count("*").alias("n"))


@query("a16_grain", f"""
select d, median(abs(r - m))::double as grain, case when median(abs(r - m)) < 4 then 0 when median(abs(r - m)) < 9 then 1 else 2 end as level
from (select d, r, c[(len(c) + 1) // 2] as m from (select d, r, list_sort(list_filter([r, {', '.join(NAMES)}], lambda v: v is not null)) as c from {around(X.PIXELS, 'r')} k) z) y group by 1""")
def _(spark, d):
    return D.grain(X.pixels(spark, d))


@query("n20_film_seams", f"""
with l as materialized (select d, x, y, ink > 0 as on_, max(x) over (partition by d) as w from {X.LABELS} q), e as (select a.d, count(*) filter (a.on_ <> z.on_) as seam, count(*) as length from l a join l z on a.d = z.d and a.y = z.y and a.x = 0 and z.x = z.w group by 1),
i as (select d, count(*) filter (on_ <> n) / 8::double as near from (select *, lead(on_) over {R_} as n from l) z where x < 4 or (x >= w - 4 and x < w) group by 1)
select e.d, seam, round(near, 4) as near, seam <= 1.5::double * near + greatest(3::double, 0.002::double * length) as ok from e join i on i.d = e.d""")
def _(spark, d):
    return D.film_seams(X.labels(spark, d))


@query("j16_facing_regions", f"""
with p as (select d, x, y, ink, lead(x) over {R_} as nx, lead(ink) over {R_} as nk from {X.LABELS} l where ink > 0) select d, ink as a, nk as b, count(*) as n from p where nx - x - 1 between 1 and 14 group by 1, 2, 3""")
def _(spark, d):
    return D.facing(X.labels(spark, d))


@query("j15_align_grid", f"""
with b as (select d, x // 2 as x, y // 2 as y, avg(r) as m from {X.PIXELS_SOFT} p group by 1, 2, 3) select a.d, count(*) as n, round(avg(abs(a.r - b.m)), 4) as mae from {X.PIXELS} a join b on a.d = b.d and a.x = b.x and a.y = b.y group by 1""")
def _(spark, d):
    return D.align_grid(X.pixels(spark, d), X.pixels(spark, d, soft=True), 2)


CURVE = "(select o_custkey as design, row_number() over (partition by o_custkey order by o_orderkey) + 1 as k, round(least(99.5, 70 + o_totalprice % 30), 2) as match from orders)"


@query("k6_suggest_inks", f"""
select design, coalesce(min(k) filter (match >= 97 or (nx - match < 1.5 and match >= 88)), max(k)) as inks, max(match) as ceiling from (select *, lead(match, 2) over (partition by design order by k) as nx from {CURVE} q) z group by 1""")
def _(spark, d):
    t = X.named(spark, d, "orders").selectExpr("o_custkey as design", "cast(row_number() over (partition by o_custkey order by o_orderkey) + 1 as bigint) as k", "round(least(99.5e0, 70 + o_totalprice % 30), 2) as match")
    return D.suggest_inks(t)


@query("k8_drop_inks", f"""
with e as materialized (select d, inki, inkj, round(de, 6) as de from {PAIRS} q), b as (select d, inki as ink, inkj as o, de from e union all select d, inkj, inki, de from e),
m as (select d, ink, o, row_number() over (partition by d, ink order by de, o) as k from b where ink >= 6 and o < 6) select t.d, t.ink, t.n as moved, m.o as "to" from {TOP} t join m on m.d = t.d and m.ink = t.ink and m.k = 1""")
def _(spark, d):
    inks = top_inks(spark, d)
    e = P.palette_pairs(inks).selectExpr("d", "inki", "inkj", "round(de, 6) as de")
    both = e.selectExpr("d", "inki as ink", "inkj as o", "de").unionByName(e.selectExpr("d", "inkj as ink", "inki as o", "de"))
    best = both.where("ink >= 6 and o < 6").groupBy("d", "ink").agg(F.min_by("o", F.struct("de", "o")).alias("to"))
    return inks.join(best, ["d", "ink"]).select("d", "ink", F.col("n").alias("moved"), "to")


@query("k3_merge_to")
def _(spark, d):
    """Each design's inks merged down to four, shades woven through each other before the least important ink."""
    inks = cut(P.with_lab(top_inks(spark, d)))
    labels = packing.by_colour(X.pixels(spark, d).selectExpr("d", "x", "y", f"{colour.packed()} as rgb"), inks.select("d", "rgb", "ink")).select("d", "x", "y", F.coalesce("ink", F.lit(-1)).alias("ink"))
    return reduce.merge_palettes(inks, 4, raster.contacts(labels))


@query("k11_merge_twins")
def _(spark, d):
    """Inks that look the same (CIEDE2000 under 3) become one; a palette of eight has no others to lose."""
    return reduce.merge_palettes(P.with_lab(top_inks(spark, d)), 8, all_twins=True)


@query("k5_reduce")
def _(spark, d):
    """Every design in four inks at most: pixels of each ink, with its colour."""
    labels, palette = reduce.reduce(X.pixels(spark, d), 4)
    n = labels.groupBy("d", "ink").agg(F.count("*").alias("pixels"))
    return n.join(palette, ["d", "ink"], "left").select("d", "ink", "pixels", "r", "g", "b")


@query("k4_feature_inks")
def _(spark, d):
    """Pixels of every design that are edges, and that are thin lines."""
    t = reduce.edges_and_features(X.pixels(spark, d))
    return t.groupBy("d").agg(F.count_if("edge").alias("edges"), F.count_if("feature").alias("features"))


KNOWN = [("screen_cost", 1e9), ("margin_percent", 1000.0), ("gst_percent", 100.0), ("wastage_percent", 100.0)]
SETTING = {"owner": "c_custkey", "name": "case c_custkey % 5 when 0 then 'screen_cost' when 1 then 'margin_percent' when 2 then 'gst_percent' when 3 then 'wastage_percent' else 'colour' end", "value": "c_acctbal / 50"}


@query("l8_check_card", "select owner, s.name, case when k.name is null then 'unknown' when value < 0 then 'negative' else 'too large' end as broken from (select " + ", ".join(f"{e} as {c}" for c, e in SETTING.items()) + " from customer) s left join (values " + ", ".join(f"('{n}', {m}::double)" for n, m in KNOWN) + ") k(name, most) on k.name = s.name where k.name is null or value < 0 or value > most")
def _(spark, d):
    return D.check_settings(X.named(spark, d, "customer").selectExpr(*[f"{e} as {c}" for c, e in SETTING.items()]), spark.createDataFrame(KNOWN, "name string, most double"))


RUN = {"similar": "o_orderkey % 4", "tiny": "o_orderkey % 3", "missed": "o_orderkey % 7 - 3", "match": "90 + o_orderkey % 12", "inks": "o_custkey % 12", "limit": "case when o_orderkey % 5 <> 0 then 8 end", "areas": "o_custkey * 3", "woven": "o_orderkey % 9 = 0", "grain": "o_orderkey % 5", "line_mm": "(o_orderkey % 4) / 10e0", "tried": "o_orderkey % 3"}
ADVICE = {"similar_inks": '"similar" > 0', "tiny_parts": "tiny > 0", "missed_numbers": "missed > 0", "match_low": "match < 99", "colours_at_limit": '"limit" > 0 and inks >= "limit"', "busy": "areas > 1500", "woven": "woven", "grainy": "not woven and grain >= 2", "thick_line_won": "line_mm > 0.17 and tried > 1"}


@query("l19_memory_summary", "select code, verdict, count(*) as n from (select o_orderstatus as verdict, unnest(list_filter([" + ", ".join(f"case when {t} then '{c}' end" for c, t in ADVICE.items()) + "], lambda c: c is not null)) as code from (select o_orderstatus, " + ", ".join(f'{e} as "{c}"' for c, e in RUN.items()) + " from orders) q) z group by 1, 2")
def _(spark, d):
    codes = rules.advice({c: F.expr(e) for c, e in RUN.items()})
    t = X.named(spark, d, "orders").select(F.col("o_orderstatus").alias("verdict"), F.explode(codes).alias("code"))
    return t.groupBy("code", "verdict").agg(F.count("*").alias("n"))


@query("l22_merge_plates", f"select d, plate, count(*) as pixels, round(avg(alpha / 255::double), 4) as tone from (select d, case screen when 0 then 'ground' else 'motif' end as plate, x, y, max(alpha) as alpha from {SOFT} s group by 1, 2, 3, 4) q group by 1, 2")
def _(spark, d):
    return D.merge_plates(soft_screens(spark, d), spark.createDataFrame([(0, "ground"), (1, "motif"), (2, "motif")], "screen int, plate string"))


EDITS = [(1, 0, 20, 0, 5, "erase"), (2, 10, 40, 2, 9, "add"), (3, 15, 30, 4, 4, "erase")]


@query("l23_replay_edits", f"""
select d, alpha, count(*) as n from (select d, case when x between 15 and 30 and y = 4 then 0 when x between 10 and 40 and y between 2 and 9 then 255 when x <= 20 and y <= 5 then 0 else cp end as alpha from {X.CHARS} c) q group by 1, 2""")
def _(spark, d):
    edits = spark.createDataFrame(EDITS, "seq int, x0 int, x1 int, y0 int, y1 int, action string")
    return D.replay_edits(X.chars(spark, d).selectExpr("d", "x", "y", "cp as alpha"), edits).groupBy("d", "alpha").agg(F.count("*").alias("n"))


@query("f10_ink_from_name", "select p_partkey, case " + " ".join(f"when contains(upper(p_name), '{w}') then '{c}'" for w, c in rules.INK_WORDS) + " else list_extract([" + ", ".join(f"'{c}'" for c in rules.CHANNEL_COLOURS) + "], (p_partkey % 12 + 1)::int) end as ink from part")
def _(spark, d):
    return X.named(spark, d, "part").select("p_partkey", rules.channel_colour(F.col("p_name"), F.col("p_partkey")).alias("ink"))


#: Descriptions: a document's text, and one of the vocabularies' words, in capitals.
SPOKEN = [w for words in (*rules.MOTIFS.values(), *rules.STYLES.values()) for w in words]
SAID = "upper(list_extract([" + ", ".join(f"'{w}'" for w in SPOKEN) + f"], (doc_id % {len(SPOKEN)} + 1)::int))"


def labelled(vocabulary):
    return "concat_ws(','," + ", ".join("case when " + " or ".join(f"contains(lower(t), '{w}')" for w in words) + f" then '{label}' end" for label, words in vocabulary.items()) + ")"


@query("f11_keywords", f"select doc_id, {labelled(rules.MOTIFS)} as motifs, {labelled(rules.STYLES)} as styles from (select doc_id, coalesce(text, '') || ' ' || {SAID} as t from documents) z")
def _(spark, d):
    said = F.upper(F.get(F.array(*map(F.lit, SPOKEN)), (F.col("doc_id") % len(SPOKEN)).cast("int")))
    t = X.named(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said).alias("t"))
    return t.select("doc_id", F.array_join(rules.keywords(F.col("t"), rules.MOTIFS), ",").alias("motifs"), F.array_join(rules.keywords(F.col("t"), rules.STYLES), ",").alias("styles"))



