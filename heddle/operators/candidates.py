"""Inks picked from a source's own colours: the strongest of each hue, and vivid colours far from each other."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from .graph import cut
from .palette import with_lab
from .reduce import spread

# Paper is lighter and greyer than this; light tones; the least chroma of a hue and of a vivid colour; weight of darkness.
PAPER_L, PAPER_CHROMA, LIGHT_L, LIGHT_LEAST, LIGHT_MOST, HUE_CHROMA, VIVID_CHROMA, DARK = 96, 4, 78, 3, 28, 10, 8, 0.12
#: RGB distance that two inks must be apart, and the luminance (0 to 255) from which a colour is paper.
APART, BARE = 28, 252.0


def shaded(counts: DataFrame) -> DataFrame:
    """Distinct colours (d, rgb, n) that are not paper, with r, g, b, ll and chroma, and hue in turns from 0 to 1."""
    # cut, else each use below would repeat the whole chain of expressions
    t = cut(spread(with_lab(counts.select("d", "rgb", "n")).select("d", "rgb", "n", *"rgb", "ll", "aa", "bb"))).selectExpr("d", "rgb", "n", "r", "g", "b", "ll", "round(sqrt(aa * aa + bb * bb), 6) as chroma", f"round((atan2(bb, aa) + {math.pi}e0) / {2 * math.pi}e0, 9) as hue")
    return t.where(f"not (ll > {PAPER_L} and chroma < {PAPER_CHROMA})")


def hue_sectors(counts: DataFrame, k: int) -> DataFrame:
    """d, sector, rgb: the colour of most chroma (and some credit for darkness) in each of ``max(k + 2, 8)`` sectors of hue, the lower on a tie; as
    sector -1 the median of the light tones' pixels, channel by channel, where there are any."""
    n = max(k + 2, 8)
    t = shaded(counts)
    score = F.round(F.col("chroma") + (100 - F.col("ll")) * DARK, 6)
    sector = F.least(F.floor(F.col("hue") * n), F.lit(n - 1)).cast("int")
    strong = t.where(f"chroma > {HUE_CHROMA}").groupBy("d", sector.alias("sector")).agg(F.max_by("rgb", F.struct(score, -F.col("rgb"))).alias("rgb"))
    light = t.where(f"ll > {LIGHT_L} and chroma > {LIGHT_LEAST} and chroma < {LIGHT_MOST}")
    middle = light.groupBy("d").agg(*[F.rint(F.percentile(c, 0.5, F.col("n"))).cast("int").alias(c) for c in "rgb"])
    return middle.select("d", F.lit(-1).alias("sector"), F.expr(colour.packed()).cast("int").alias("rgb")).unionByName(strong.withColumn("rgb", F.col("rgb").cast("int")))


def apart(rgb: np.ndarray, k: int) -> list[int]:
    """Of colours in their order, those that are no paper and are far from all taken before, ``k`` at most."""
    taken: list[int] = []
    for key in rgb.tolist():
        c = np.array([key >> 16, key >> 8 & 255, key & 255])
        if c @ (0.2126, 0.7152, 0.0722) < BARE and all(((c - (o >> 16, o >> 8 & 255, o & 255)) ** 2).sum() > APART**2 for o in taken):
            taken.append(key)
    return taken[:k]


def candidate_inks(counts: DataFrame, k: int) -> DataFrame:
    """d, method (hue or vivid), ink, rgb: two sets of ``k`` inks at most; a set of one colour is none.

    ``hue`` takes the colours of ``hue_sectors`` in order. ``vivid`` starts from the colour of most chroma and goes on to the one farthest in
    Lab from all before; it looks at all distinct colours, so pixels never count twice. A group holds a design's distinct colours.
    """
    kind = dict(counts.dtypes)["d"]

    def rows(d, method: str, keys: list[int]) -> pd.DataFrame:
        keys = keys if len(keys) > 1 else []
        return pd.DataFrame({"d": [d] * len(keys), "method": method, "ink": range(len(keys)), "rgb": keys})

    def hues(group: pd.DataFrame) -> pd.DataFrame:
        return rows(group["d"].iloc[0], "hue", apart(group.sort_values("sector")["rgb"].to_numpy(), k))

    def vivid(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rgb")
        rgb = group["rgb"].to_numpy()
        lab = colour.lab_array(np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], 1))
        at, far, picked = int(group["chroma"].to_numpy().argmax()), np.full(len(rgb), np.inf), []
        while len(picked) < min(k, len(rgb)):
            picked.append(at)
            far = np.minimum(far, ((lab - lab[at]) ** 2).sum(1))
            at = int(far.argmax())
        return rows(group["d"].iloc[0], "vivid", apart(rgb[picked], k))

    schema = f"d {kind}, method string, ink int, rgb int"
    strong = spread(hue_sectors(counts, k)).groupBy("d").applyInPandas(hues, schema)
    bright = spread(shaded(counts).where(f"chroma > {VIVID_CHROMA}").selectExpr("d", "cast(rgb as int) as rgb", "chroma")).groupBy("d").applyInPandas(vivid, schema)
    return strong.unionByName(bright)
