"""Palette jobs: distinct colours, nearest inks, coverage, match and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour, layers


def colour_counts(pixels: DataFrame) -> DataFrame:
    """Distinct colours of each design among opaque pixels, with counts; partial counts are made before the shuffle."""
    return pixels.where("a >= 128").selectExpr("d", f"{colour.packed()} as rgb").groupBy("d", "rgb").agg(F.count("*").alias("n"))


def with_lab(colours: DataFrame, key: str = "rgb", s: str = "") -> DataFrame:
    """Lab of packed colours."""
    wide = colours.selectExpr("*", *[f"{e} as {c}{s}" for c, e in colour.unpacked(key).items()])
    return layers.add(wide, colour.lab(s, f"r{s}", f"g{s}", f"b{s}"))


def nearest_ink(counts: DataFrame, palette: DataFrame) -> DataFrame:
    """Each distinct colour's nearest ink by squared Lab distance, the lowest ink on a tie. The palette is a few rows, one set for all designs."""
    inks = layers.add(palette, colour.lab("p", "pr", "pg", "pb")).select("ink", "llp", "aap", "bbp")
    pairs = with_lab(counts).crossJoin(F.broadcast(inks)).selectExpr("d", "rgb", "n", "ll", "aa", "bb", "ink", "llp", "aap", "bbp", f"{colour.squared('', 'p')} as d2")
    best = pairs.groupBy("d", "rgb", "n").agg(F.min_by(F.struct("ink", "ll", "aa", "bb", "llp", "aap", "bbp"), F.struct("d2", "ink")).alias("m"))
    return best.select("d", "rgb", "n", "m.*")


def nearest_own(counts: DataFrame, palettes: DataFrame) -> DataFrame:
    """Each distinct colour's nearest ink of its own design, by squared Lab distance, the lowest ink on a tie. A palette is a few inks."""
    inks = layers.add(palettes, colour.lab("p", "pr", "pg", "pb")).select("d", "ink", "pr", "pg", "pb", "llp", "aap", "bbp")
    pairs = with_lab(counts).join(inks, "d").withColumn("d2", F.expr(colour.squared("", "p")))
    best = pairs.groupBy("d", "rgb", "n").agg(F.min_by(F.struct("ink", "pr", "pg", "pb", "ll", "aa", "bb", "llp", "aap", "bbp"), F.struct("d2", "ink")).alias("m"))
    return best.select("d", "rgb", "n", "m.*")


def coverage_and_match(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """By design and ink: pixels, coverage %, mean CIEDE2000 and match of 100 * (1 - mean / 25), ranked by pixels.

    Work is done once per distinct colour, and the weighted mean over colours is the mean over all pixels.
    """
    mapped = layers.add(nearest_ink(colour_counts(pixels), palette), colour.de2000("", "p"))
    inks = mapped.groupBy("d", "ink").agg(F.sum("n").alias("pixels"), (F.sum(F.col("n") * F.col("de")) / F.sum("n")).alias("mean_de"))
    total, rank = Window.partitionBy("d"), Window.partitionBy("d").orderBy(F.desc("pixels"), "ink")
    return inks.select("d", "ink", "pixels", F.round(100 * F.col("pixels") / F.sum("pixels").over(total), 4).alias("coverage"), F.round("mean_de", 4).alias("mean_de"), F.round(100 * F.greatest(F.lit(0.0), 1 - F.col("mean_de") / 25), 4).alias("match"), F.row_number().over(rank).alias("rank"))


def ink_count(counts: DataFrame, floor: float = 0.001) -> DataFrame:
    """Number of colours that cover at least ``floor`` of their design."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("d"))
    return counts.withColumn("_s", share).groupBy("d").agg(F.sum((F.col("_s") >= floor).cast("long")).alias("inks"))


def flat_palette(counts: DataFrame, most: int = 64, share: float = 0.97, floor: float = 0.001) -> DataFrame:
    """Whether a design is flat: few colours reach the floor, and they cover nearly all."""
    marked = counts.withColumn("_s", F.col("n") / F.sum("n").over(Window.partitionBy("d")))
    kept = F.col("_s") >= floor
    rows = marked.groupBy("d").agg(F.sum(kept.cast("long")).alias("kept"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("_k"), F.sum("n").alias("_n"))
    return rows.select("d", "kept", F.round(F.col("_k") / F.col("_n"), 6).alias("share"), ((F.col("kept") <= most) & (F.col("_k") / F.col("_n") > share)).alias("flat"))


def coverage(labels: DataFrame) -> DataFrame:
    """Pixels of each ink, as % of the inked and of all pixels, ranked."""
    n = labels.groupBy("d", "ink").agg(F.count("*").alias("n"))
    n = n.withColumn("_all", F.sum("n").over(Window.partitionBy("d"))).where("ink >= 0")
    return n.select("d", "ink", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("d")), 4).alias("of_inked"), F.round(100 * F.col("n") / F.col("_all"), 4).alias("of_area"), F.row_number().over(Window.partitionBy("d").orderBy(F.desc("n"), "ink")).alias("rank"))


def coverage_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the sum of absolute differences of two designs' ink shares, in %."""
    x, y = [coverage(t).select("d", "ink", F.col("of_inked").alias(n)) for t, n in ((a, "x"), (b, "y"))]
    gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return x.join(y, ["d", "ink"], "full").groupBy("d").agg(F.round(F.sum(gap) / 2, 3).alias("difference"))


def palette_of(counts: DataFrame, k: int = 8) -> DataFrame:
    """The k commonest colours of each design as inks 0 to k - 1; ties go to the lower colour."""
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("n"), "rgb"))
    return counts.withColumn("ink", rank - 1).where(F.col("ink") < k)


def palette_pairs(inks: DataFrame) -> DataFrame:
    """Pairs of a design's inks, i < j, with their CIEDE2000 difference. Palettes hold a few inks, so pairs stay few."""
    t = with_lab(inks).select("d", "ink", "rgb", "n", "ll", "aa", "bb")
    x, y = [t.select("d", *[F.col(c).alias(f"{c}{s}") for c in ("ink", "rgb", "n", "ll", "aa", "bb")]) for s in ("i", "j")]
    return layers.add(x.join(y, "d").where("inki < inkj"), colour.de2000("i", "j"))


def similar_inks(inks: DataFrame, threshold: float = 5.0, most: int = 3) -> DataFrame:
    """The closest pairs under ``threshold``: the ink of more pixels stays, the lower one on a tie."""
    near = palette_pairs(inks)  # all pairs are ranked before the test, which would else move below and repeat the whole formula
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.round("de", 6), "inki", "inkj"))
    near = near.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("de") < threshold))
    first = F.col("ni") >= F.col("nj")
    return near.select("d", "rank", F.when(first, F.col("inki")).otherwise(F.col("inkj")).alias("keep"), F.when(first, F.col("inkj")).otherwise(F.col("inki")).alias("drop"), F.round("de", 4).alias("de"))


def shelf_pairs(inks: DataFrame, shelf: DataFrame, within: float) -> DataFrame:
    """d, ink, key, name, de of each ink and each shelf ink at most ``within`` (CIEDE2000) apart. Distinct colours meet the shelf once; it is
    bounded (500 inks), so it is broadcast."""
    s = layers.add(shelf, colour.lab("s", "sr", "sg", "sb")).select("key", "name", "lls", "aas", "bbs")
    pairs = layers.add(with_lab(inks.select("rgb").distinct()).select("rgb", "ll", "aa", "bb").crossJoin(F.broadcast(s)), colour.de2000("", "s"))
    return inks.join(pairs.where(F.col("de") <= within).select("rgb", "key", "name", "de"), "rgb").select("d", "ink", "key", "name", "de")


def match_shelf(inks: DataFrame, shelf: DataFrame) -> DataFrame:
    """Each ink's nearest shelf ink by CIEDE2000, the lower name and key on a tie, with a tone: same to 1, close to 5, else far.

    Distinct colours are matched once; the shelf is bounded (500 inks), so it is broadcast.
    """
    s = layers.add(shelf, colour.lab("s", "sr", "sg", "sb")).select("key", "name", "lls", "aas", "bbs")
    pairs = layers.add(with_lab(inks.select("rgb").distinct()).select("rgb", "ll", "aa", "bb").crossJoin(F.broadcast(s)), colour.de2000("", "s"))
    best = pairs.groupBy("rgb").agg(F.min_by(F.struct("name", "key", "de"), F.struct(F.round("de", 6), "name", "key")).alias("m"))
    tone = F.when(F.col("m.de") <= 1, "same").when(F.col("m.de") <= 5, "close").otherwise("far")
    return inks.join(best, "rgb").select("d", "ink", "rgb", F.col("m.name").alias("shelf_name"), F.round("m.de", 4).alias("de"), tone.alias("tone"))


def small_inks(inks: DataFrame, below: float = 2.0, distinct: float = 5.0) -> DataFrame:
    """Inks under ``below`` % of a design, the extra difference if their pixels go to the nearest other ink, and whether they are distinct."""
    pairs = palette_pairs(inks)
    both = pairs.selectExpr("d", "inki as ink", "de").unionByName(pairs.selectExpr("d", "inkj as ink", "de"))
    near = both.groupBy("d", "ink").agg(F.min("de").alias("extra"))
    shares = inks.withColumn("coverage", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("d"))).where(F.col("coverage") < below)
    return shares.join(near, ["d", "ink"]).select("d", "ink", F.round("coverage", 4).alias("coverage"), F.round("extra", 4).alias("extra"), (F.round("extra", 6) >= distinct).alias("kept"))


def merge_stray(counts: DataFrame, share: float = 0.0005) -> DataFrame:
    """Colours under ``share`` of a design go to the nearest (RGB) of its others, the lower colour on a tie."""
    parts = counts.withColumn("_big", F.col("n") >= F.sum("n").over(Window.partitionBy("d")) * share)
    rgb = [f"{e} as {c}" for c, e in colour.unpacked("rgb").items()]
    big = parts.where("_big").selectExpr("d", "rgb as to_rgb", *[f"{e} as t{c}" for c, e in colour.unpacked("rgb").items()])
    stray = parts.where("not _big").selectExpr("d", "rgb", "n", *rgb)
    d2 = F.expr("(r - tr) * (r - tr) + (g - tg) * (g - tg) + (b - tb) * (b - tb)")
    best = stray.join(big, "d").groupBy("d", "rgb", "n").agg(F.min_by("to_rgb", F.struct(d2, "to_rgb")).alias("to_rgb"))
    return best.select("d", "rgb", "n", "to_rgb")


def press_order(palette: DataFrame) -> DataFrame:
    """Lightest ink first (on index for equals), and the file stem of each screen."""
    t = layers.add(palette, colour.lab("", "pr", "pg", "pb"))
    ranked = t.withColumn("place", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("ll"), "ink")))
    return ranked.select("d", "ink", "place", F.concat(F.lpad(F.col("place").cast("string"), 2, "0"), F.lit("_"), F.expr(f"substring({colour.hex_digits('pr', 'pg', 'pb')}, 2, 6)")).alias("stem"))


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One assignment of weighted colours to centres (rgb space of Lab) and the new weighted centres."""
    c = layers.add(centres, colour.lab("p", "pr", "pg", "pb")).select("ink", "llp", "aap", "bbp")
    pairs = with_lab(points).crossJoin(F.broadcast(c)).selectExpr("rgb", "n", "ll", "aa", "bb", "ink", f"{colour.squared('', 'p')} as d2")
    best = pairs.groupBy("rgb", "n", "ll", "aa", "bb").agg(F.min_by("ink", F.struct("d2", "ink")).alias("ink"))
    mean = lambda c: F.round(F.sum(F.col("n") * F.col(c)) / F.sum("n"), 4).alias(c)
    return best.groupBy("ink").agg(F.sum("n").alias("n"), mean("ll"), mean("aa"), mean("bb"))
