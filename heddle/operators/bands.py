"""Bands of rasters as arrays inside tasks: for passes that look at many neighbours of a pixel at once.

Spark deals the bands out packed (one shuffle, see ``packing``); a task holds some bands and their halos at a time, whatever the height of
the design.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import KINDS, ROWS, Stack, out_schema, over_bands

Grids = dict[str, np.ndarray]


def moved(a: np.ndarray, dy: int, dx: int, beyond: float) -> np.ndarray:
    """The array whose cell (y, x) is ``a``'s (y + dy, x + dx), or ``beyond``."""
    h, w = a.shape
    out = np.full(a.shape, beyond, a.dtype)
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if y0 < y1 and x0 < x1:
        out[y0:y1, x0:x1] = a[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return out


def eight(a: np.ndarray, beyond: float) -> list[np.ndarray]:
    """The eight neighbours of every cell."""
    return [moved(a, dy, dx, beyond) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def line_means(v: np.ndarray, there: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Means of the present cells within ``r`` along an axis; 0 where there is no cell."""
    step = lambda k: (k, 0) if axis == 0 else (0, k)
    held, one = np.where(there, v, 0.0), there.astype(float)
    total, n = held.copy(), one.copy()
    for k in (k for k in range(-r, r + 1) if k):
        total += moved(held, *step(k), 0.0)
        n += moved(one, *step(k), 0.0)
    return np.where(there, total / np.maximum(n, 1.0), 0.0)


def spans(v: np.ndarray, there: np.ndarray, r: int) -> np.ndarray:
    """Maximum less minimum of the present cells of the (2 r + 1) square."""
    high, low = np.where(there, v, -np.inf), np.where(there, v, np.inf)
    for axis in (1, 0):
        high, low = (pick.reduce([moved(a, *((k, 0) if axis == 0 else (0, k)), end) for k in range(-r, r + 1)]) for pick, a, end in ((np.maximum, high, -np.inf), (np.minimum, low, np.inf)))
    return np.where(there, high - low, 0.0)


def by_band(raster: DataFrame, halo: int, kernel: Callable[[np.ndarray, Grids], Grids], makes: dict[str, str], looks: list[str] | None = None, keep: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """d, x, y, the columns ``keep`` as they are, and those that ``kernel`` makes (name to SQL type; masked arrays: null where masked) of the columns
    ``looks`` (all, if None).

    The kernel gets which cells there are, and each column as an array (0 where there is no cell, or the value is null; which cells have a value is
    the array "?" and the name), and gives arrays back. It may look ``halo`` rows beyond a cell: bands lie that far apart in a grid.
    """
    looks = [c for c in raster.columns if c not in ("d", "x", "y")] if looks is None else looks
    keep = keep or []
    raster = raster.select("d", "x", "y", *dict.fromkeys([*keep, *looks]))

    def look(stack: Stack) -> pa.RecordBatch:
        (side,) = stack.sides
        there, grids = np.zeros(stack.shape, bool), {}
        there[side.row, side.x] = True
        for c in looks:
            column = side.columns[c]
            grids["?" + c] = there
            if column.null_count:
                grids["?" + c] = np.zeros(stack.shape, bool)
                grids["?" + c][side.row, side.x] = column.is_valid().to_numpy(zero_copy_only=False)
                column = column.fill_null(pa.scalar(0).cast(column.type))
            values = column.to_numpy(zero_copy_only=False)
            grids[c] = np.zeros(stack.shape, values.dtype)
            grids[c][side.row, side.x] = values
        made, own = kernel(there, grids), np.flatnonzero(side.own)
        row, x, of = side.row[own], side.x[own], pa.array(own)
        arrays = [stack.d.take(pa.array(side.band[own])), *(side.columns[c].take(of) for c in ("x", "y", *keep))]
        for c, kind in makes.items():
            grid = made[c]
            none = grid.mask[row, x] if isinstance(grid, np.ma.MaskedArray) and grid.mask is not np.ma.nomask else None
            arrays.append(pa.array(np.asarray(grid)[row, x], mask=none).cast(KINDS[kind], safe=False))
        return pa.RecordBatch.from_arrays(arrays, names=["d", "x", "y", *keep, *makes])

    return over_bands([raster], halo, look, out_schema(raster, keep, makes), rows)
