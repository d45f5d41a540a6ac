"""Geometry on pixels, named colours, blends, and palette methods that plug in and are scored alike."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour, layers
from ..functions.text import COLOURS  # noqa: F401
from .palette import with_lab
from .raster import OFFSETS, beside, square


def in_polygon(pixels: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """``inside`` by the even-odd rule: how many edges a ray to the right crosses."""
    crossed = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y0 != y1:
            at = F.lit(x0) + (F.col("y") - y0) * ((x1 - x0) / (y1 - y0))
            crossed = crossed + (((F.lit(y0) > F.col("y")) != (F.lit(y1) > F.col("y"))) & (F.col("x") < at)).cast("int")
    return pixels.withColumn("inside", crossed % 2 == 1)


def lay_repeat(tile: DataFrame, width: int, height: int, columns: int, rows: int, mode: str = "straight") -> DataFrame:
    """Copies of a tile, placed straight, in half drop (odd columns half a tile down), brick (odd rows half a tile right) or mirror."""
    x, y, cx, cy = F.col("x"), F.col("y"), F.col("cx"), F.col("cy")
    if mode == "mirror":
        x, y = F.when(cx % 2 == 1, width - 1 - x).otherwise(x), F.when(cy % 2 == 1, height - 1 - y).otherwise(y)
    down = F.when(cx % 2 == 1, height // 2).otherwise(0) if mode == "half-drop" else F.lit(0)
    right = F.when(cy % 2 == 1, width // 2).otherwise(0) if mode == "brick" else F.lit(0)
    placed = tile.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return placed.select("d", (x + width * cx + right).alias("px"), (y + height * cy + down).alias("py"), "r")


def near_mask(mask: DataFrame, r: int) -> DataFrame:
    """Whether a set pixel lies in the (2 r + 1) square around each pixel."""
    return square(mask, r, {"near": ("max", "m")})


def boundary(labels: DataFrame) -> DataFrame:
    """Unit edges and area of each ink: an edge stands between unlike pixels and at the raster's end."""
    differs = lambda c: F.coalesce((c != F.col("ink")).cast("int"), F.lit(1))
    edges = sum((differs(F.col(n)) for n in "wens"), F.lit(0))
    return beside(labels, "ink", {n: OFFSETS[n] for n in "wens"}, ["ink"]).withColumn("_e", edges).where("ink >= 0").groupBy("d", "ink").agg(F.sum("_e").alias("edges"), F.count("*").alias("area"))


def blend_inks(inks: DataFrame, low: float = 0.2, high: float = 0.8, gap: float = 12.0) -> DataFrame:
    """Inks k that lie between inks i < j of their design in Lab: place t on the line and gap from it."""
    side = lambda n: inks.select("d", F.col("ink").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("ll", "aa", "bb")])
    t = side("i").join(side("j"), "d").where("i < j").join(side("k"), "d").where("k != i and k != j")
    dot = sum(((F.col(f"{c}_k") - F.col(f"{c}_i")) * (F.col(f"{c}_j") - F.col(f"{c}_i")) for c in ("ll", "aa", "bb")), F.lit(0.0))
    length = sum((F.pow(F.col(f"{c}_j") - F.col(f"{c}_i"), 2) for c in ("ll", "aa", "bb")), F.lit(0.0))
    t = t.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.when(length != 0, length))))
    off = F.sqrt(sum((F.pow(F.col(f"{c}_k") - F.col(f"{c}_i") - F.col("t") * (F.col(f"{c}_j") - F.col(f"{c}_i")), 2) for c in ("ll", "aa", "bb")), F.lit(0.0)))
    return t.withColumn("gap", off).where(F.col("t").between(low, high) & (F.col("gap") < gap)).select("d", "i", "j", "k", F.round("t", 4).alias("t"), F.round("gap", 4).alias("gap"))


def colour_names(colours: DataFrame, names: DataFrame) -> DataFrame:
    """Nearest colour name (CIE76) of each packed colour, the earlier name on a tie. ``names``: a few dozen rows, broadcast."""
    s = layers.add(names, colour.lab("s", "sr", "sg", "sb")).select("place", "name", "lls", "aas", "bbs")
    pairs = with_lab(colours).crossJoin(F.broadcast(s)).withColumn("de", F.round(F.expr(colour.de76("", "s")), 6))
    return pairs.groupBy("rgb").agg(F.min_by("name", F.struct("de", "place")).alias("name"))


def best_of(trials: DataFrame) -> DataFrame:
    """The best trial of each design; the first name on a tie."""
    rank = F.row_number().over(Window.partitionBy("design").orderBy(F.desc("match"), "name"))
    return trials.withColumn("_r", rank).where("_r = 1").select("design", "name", "match")


#: Palette methods by name: f(colours, counts, k) -> centres, on a design's distinct colours in Lab.
METHODS: dict[str, Callable[[np.ndarray, np.ndarray, int], np.ndarray]] = {}


def method(name: str):
    def keep(f):
        METHODS[name] = f
        return f

    return keep


@method("commonest")
def commonest(points: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    return points[np.argsort(-counts, kind="stable")[:k]]


@method("farthest")
def farthest(points: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Weighted farthest points from the commonest colour on: the same under any partitioning."""
    picked = [int(np.argmax(counts))]
    near = ((points - points[picked[0]]) ** 2).sum(1)
    while len(picked) < min(k, len(points)) and (near * counts).max() > 0:
        picked.append(int(np.argmax(near * counts)))
        near = np.minimum(near, ((points - points[picked[-1]]) ** 2).sum(1))
    return points[picked]


@method("k-means")
def k_means(points: np.ndarray, counts: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means from farthest-point seeds."""
    centres = farthest(points, counts, k)
    for _ in range(rounds):
        owner = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        weight = np.bincount(owner, counts, len(centres))
        sums = np.stack([np.bincount(owner, counts * points[:, i], len(centres)) for i in range(3)], 1)
        centres = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1)[:, None], centres)
    return centres


def score_methods(counts: DataFrame, k: int) -> DataFrame:
    """d, method, error: the weighted mean squared Lab distance of a design's colours from each method's palette.

    A design's group holds its distinct colours only (at most 2**24, a few dozen in a flat design), never its pixels.
    """

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rgb")
        points, n = group[["ll", "aa", "bb"]].to_numpy(float), group["n"].to_numpy(float)
        error = {name: float((((points[:, None] - f(points, n, k)[None]) ** 2).sum(2).min(1) * n).sum() / n.sum()) for name, f in METHODS.items()}
        return pd.DataFrame({"d": group["d"].iloc[0], "method": list(error), "error": [round(e, 4) for e in error.values()]})

    return counts.groupBy("d").applyInPandas(score, "d long, method string, error double")
