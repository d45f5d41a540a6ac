"""Rules of printing as column expressions: dots, mesh, ink, strategy, verdicts, channel colours, keywords."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grams of wet ink per square metre, by plate type.
DEPOSIT_RATES = {"underbase": 50.0, "spot": 30.0, "tonal": 18.0, "halftone": 18.0}
# Dots finer than most mesh holds, and dots that show as a pattern, in mm.
TOO_FINE_MM, SHOWS_MM = 0.12, 0.45
# Gradient score from which a design is tonal, and the inks that a hybrid needs.
TONAL_SCORE, HYBRID_INKS = 0.08, 4
# Verdict bands, as (from, label), highest first.
ALIGNMENT_BANDS = [(0.85, "good"), (0.55, "low"), (None, "very low")]
MATCH_BANDS = [(90.0, "good"), (85.0, "near"), (None, "loose")]
# Ink words in channel names with their colours, in the order in which they are looked for, and colours for other channels.
INK_WORDS = [
    ("BLACK", "#1A1A1A"), ("WHITE", "#FFFFFF"), ("SILVER", "#C0C4C8"), ("GREY", "#8A8D90"), ("GRAY", "#8A8D90"), ("GOLD", "#C8A13A"), ("COPPER", "#B46A3C"), ("BRONZE", "#A97142"),
    ("MAROON", "#7B2233"), ("BROWN", "#6B4530"), ("BEIGE", "#D8C7A8"), ("CREAM", "#EFE3C8"), ("NAVY", "#1E2A4A"), ("TURQUOISE", "#2FA5A0"), ("TEAL", "#2A7F7B"), ("OLIVE", "#6B6B3A"),
    ("MUSTARD", "#C8A02A"), ("ORANGE", "#E1701A"), ("PURPLE", "#6B3FA0"), ("VIOLET", "#7A4BB5"), ("MAGENTA", "#C2185B"), ("PINK", "#D96A8E"), ("YELLOW", "#E8C317"), ("GREEN", "#3E7C47"), ("BLUE", "#2A5DA8"), ("RED", "#C0392B"),
]
CHANNEL_COLOURS = ["#E63946", "#457B9D", "#2A9D8F", "#E9C46A", "#F4A261", "#8338EC", "#3A86FF", "#FF006E", "#06D6A0", "#FFD166", "#118AB2", "#073B4C"]
# Vocabularies of design descriptions.
MOTIFS = {
    "floral": ["floral", "flower", "rose", "lotus", "blossom", "phool"],
    "paisley": ["paisley", "buta", "buti", "mango", "kairi", "ambi"],
    "creeper": ["creeper", "bel", "vine", "jaal", "jaali", "trailing"],
    "geometric": ["geometric", "geometry", "check", "stripe", "chevron", "diamond", "triangle"],
    "botanical": ["botanical", "leaf", "leaves", "foliage", "branch", "plant"],
    "abstract": ["abstract", "freeform", "organic shapes"],
    "ornamental": ["ornamental", "ornate", "damask", "motif", "border", "ethnic"],
    "traditional": ["traditional", "ethnic", "heritage"],
}
STYLES = {
    "Mughal-inspired": ["mughal", "mugal"],
    "Persian": ["persian", "irani"],
    "Indian traditional": ["indian", "rajasthani", "jaipuri", "banarasi", "traditional"],
    "botanical": ["botanical", "naturalistic"],
    "contemporary": ["contemporary", "modern", "minimal", "minimalist"],
    "abstract": ["abstract"],
}
# Limits of the advice on a run: match of the sketch in %, parts, grain, line in mm.
MATCH_LOW, BUSY_AREAS, GRAINY, THICK_LINE_MM = 99.0, 1500, 2.0, 0.17
# Share of a design, in %, under which an ink is small.
SMALL_SHARE = 1.5


def rounded(value: Column | str, places: int) -> Column:
    """Rounded to ``places``, halves away from zero, on the scaled double, as databases round: 1.005 is 1.0, since its double is less."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double") * 10.0**places) / 10.0**places


def dot_area(mm: Column, dpi: Column) -> Column:
    """Largest island, in pixels, that is smaller than a round dot of ``mm`` across; 0 where no size is given."""
    return F.when(F.coalesce(mm, F.lit(0.0)) == 0, 0).otherwise(F.floor(math.pi / 4 * F.pow(mm * dpi / 25.4, F.lit(2.0)))).cast("long")


def dot_pixels(native_width: Column, print_width: Column) -> Column:
    """Film pixels on a side of one dot: the design's pixels scaled to the print, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.rint(print_width / native_width)).cast("long")


def dot_verdict(mm: Column) -> Column:
    return F.when(mm < TOO_FINE_MM, "too fine for most mesh").when(mm > SHOWS_MM, "pattern will show").otherwise("ok")


def mesh(plate: Column, lpi: Column) -> Column:
    """Mesh range of a polyester screen; tonal plates without a ruling count as 45 lines an inch."""
    kind, ruling = F.lower(F.coalesce(plate, F.lit("spot"))), F.coalesce(F.when(lpi != 0, lpi), F.lit(45))
    tonal = kind.isin("tonal", "halftone")
    return F.when(kind == "underbase", "110-156").when(tonal & (ruling <= 45), "200-230").when(tonal & (ruling <= 55), "230-280").when(tonal, "305-355").otherwise("156-230")


def ink_grams(width_px: Column, height_px: Column, dpi: Column, coverage: Column, plate: Column) -> Column:
    """Grams of wet ink for 100 prints, to a tenth, halves to even; null for an unknown plate type. Coverage is a share, cut to 0 to 1."""
    rate = F.try_element_at(F.create_map(*[F.lit(x) for pair in DEPOSIT_RATES.items() for x in pair]), F.lower(plate))
    side = lambda px: px / F.greatest(F.lit(72), dpi) * 0.0254
    return F.rint(side(width_px) * side(height_px) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage)) * rate * 100.0 * 10) / 10


def recommend(gradient_score: Column, max_inks: Column) -> Column:
    """spot, halftone or hybrid."""
    return F.when(F.coalesce(gradient_score, F.lit(0.0)) < TONAL_SCORE, "spot").when(max_inks >= HYBRID_INKS, "hybrid").otherwise("halftone")


def band(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    """Label of the first band that ``value`` reaches, of bands from the highest down; null for null."""
    out = None
    for least, label in bands:
        test = value.isNotNull() if least is None else value >= least
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def channel_colour(name: Column, index: Column) -> Column:
    """Colour of a spot channel: by the first ink word, in the list's order, that its name holds; else the palette's next colour."""
    upper, out = F.upper(F.coalesce(name, F.lit(""))), None
    for word, code in INK_WORDS:
        out = F.when(F.contains(upper, F.lit(word)), code) if out is None else out.when(F.contains(upper, F.lit(word)), code)
    return out.otherwise(F.get(F.array(*map(F.lit, CHANNEL_COLOURS)), (index % len(CHANNEL_COLOURS)).cast("int")))


def keywords(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """Labels of the vocabulary, in its order, any of whose words stands in the text. Null texts have none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: lower.rlike("|".join(words))
    return F.filter(F.array(*[F.when(hit(words), F.lit(label)) for label, words in vocabulary.items()]), lambda x: x.isNotNull())


def advice(run: dict[str, Column]) -> Column:
    """Codes of what a run's numbers show, most important first. ``run``: similar, tiny, missed, match, inks, limit, areas, woven, grain, line_mm, tried."""
    at_limit = (F.coalesce(run["limit"], F.lit(0)) > 0) & (run["inks"] >= run["limit"])
    rules = [
        ("similar_inks", run["similar"] > 0), ("tiny_parts", run["tiny"] > 0), ("missed_numbers", run["missed"] > 0), ("match_low", run["match"] < MATCH_LOW), ("colours_at_limit", at_limit),
        ("busy", run["areas"] > BUSY_AREAS), ("woven", run["woven"]), ("grainy", ~F.coalesce(run["woven"], F.lit(False)) & (run["grain"] >= GRAINY)), ("thick_line_won", (run["line_mm"] > THICK_LINE_MM) & (run["tried"] > 1)),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules]), lambda c: c.isNotNull())


def run_features(width: Column, height: Column, grain: Column, areas: Column, tiny: Column, shares: Column) -> Column:
    """struct(grain, areas_per_mpx, inks, top_share, small_inks, tiny_per_mpx): the numbers by which past designs are compared. ``shares``: each ink's % of the design."""
    mpx = F.greatest(width * height / 1e6, F.lit(1e-6))
    return F.struct(
        F.coalesce(grain, F.lit(0.0)).alias("grain"), (F.rint(areas / mpx * 10) / 10).alias("areas_per_mpx"), F.size(shares).alias("inks"), F.coalesce(F.array_max(shares), F.lit(100.0)).alias("top_share"),
        F.size(F.filter(shares, lambda s: s < SMALL_SHARE)).alias("small_inks"), (F.rint(F.coalesce(tiny, F.lit(0)) / mpx * 100) / 100).alias("tiny_per_mpx"),
    )


def batch_result(exit_code: Column, log: Column) -> Column:
    """OK, STOP where a line of the log begins so, else CHECK."""
    return F.when(exit_code == 0, "OK").when(F.coalesce(log, F.lit("")).rlike("(?m)^STOP"), "STOP").otherwise("CHECK")
