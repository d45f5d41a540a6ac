"""Continuous tones: how much of each ink gives a colour, and the colour that inks give when printed over each other.

Inks absorb: a full ink takes away 1 - ink / paper of each channel, tones scale that, and absorptions add up to 1 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 400


def absorptions(inks: np.ndarray, paper: tuple[int, int, int]) -> np.ndarray:
    """What each full ink takes away of each channel (inks x 3)."""
    return np.clip(1 - inks / np.maximum(np.array(paper, float), 1), 0, 1)


def solved(target: np.ndarray, take: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Tones in 0 to 1 whose absorptions come nearest to ``target`` (colours x 3): projected gradient with momentum, all colours at once.

    The start is no ink, so of many exact mixtures one near to little ink is found, the same on every run.
    """
    length = max(float(np.linalg.eigvalsh(take @ take.T).max(initial=0.0)), 1e-9)
    now = before = np.zeros((len(target), len(take)))
    for k in range(rounds):
        ahead = now + (k / (k + 3)) * (now - before)
        before, now = now, np.clip(ahead - (ahead @ take - target) @ take.T / length, 0, 1)
    return now


def solve_tones(colours: DataFrame, inks: DataFrame, paper: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """``colours`` (d, rgb, ...) with inks (ids, lowest first) and tones (0 to 1, rounded to 6 digits) of their design's palette (d, ink, r, g, b).

    Solved once per distinct colour of a design; a palette is a few inks and rides along as an array. Designs without inks have no rows.
    """
    packed = inks.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("ink", "r", "g", "b"))).alias("_p"))
    each = packed.select("d", F.col("_p.ink").alias("inks"), F.flatten(F.transform("_p", lambda p: F.array(*[p[c].cast("double") for c in "rgb"]))).alias("_flat"))
    wide = colours.select("d", "rgb").distinct().join(each, "d").select("d", "rgb", "inks", "_flat")
    kind = dict(colours.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = batch.column(1).to_numpy().astype(np.int64)
            target = absorptions(np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], 1).astype(float), paper)
            palettes, tones = [tuple(p) for p in batch.column(3).to_pylist()], [None] * len(rgb)
            for palette in set(palettes):
                at = [i for i, p in enumerate(palettes) if p == palette]
                found = solved(target[at], absorptions(np.array(palette).reshape(-1, 3), paper))
                for i, t in zip(at, np.round(found, 6).tolist(), strict=True):
                    tones[i] = t
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(tones, pa.list_(pa.float64()))], names=["d", "rgb", "inks", "tones"])

    ink = dict(inks.dtypes)["ink"]
    return colours.join(wide.mapInArrow(run, f"d {kind['d']}, rgb {kind['rgb']}, inks array<{ink}>, tones array<double>"), ["d", "rgb"])


def overprint(tones: Column, inks: Column, paper: tuple[int, int, int] = (255, 255, 255)) -> dict[str, Column]:
    """Channels r, g, b of printed tones. ``inks``: an array of structs r, g, b, as many and in the same order."""

    def channel(c: str, p: int) -> Column:
        within = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        take = F.transform(inks, lambda i: within(1 - i[c] / F.lit(float(max(p, 1)))))
        total = F.aggregate(F.zip_with(tones, take, lambda t, a: t * a), F.lit(0.0), lambda s, v: s + v)
        return F.round(F.round(F.lit(float(p)) * (1 - within(total)), 6)).cast("int")

    return {c: channel(c, p) for c, p in zip("rgb", paper, strict=True)}
