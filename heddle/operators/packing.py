"""Rasters packed for shuffles: the pixels that a task holds of one band become one compressed row, and are looked at as arrays after it.

Pixels as rows cost a shuffle and a sort some forty bytes each, packed ones about one. Packing goes batch by batch, so a task holds one batch, and
after the shuffle some whole bands; a design of any height spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Rows in a band of arrays.
ROWS = 128
#: Pixels of whole bands that a task looks at together, and cells of a grid for them.
TOGETHER, CELLS = 300_000, 4_000_000
CODEC = "zstd"
#: Distinct rows of a batch (or a quarter of all) up to which they are held once.
FEW = 256
KINDS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


@dataclass
class Side:
    """Pixels of one raster in a stack, in any order: place in the grid, number of the band, whether it is the band's own, and all columns but d."""

    row: np.ndarray
    x: np.ndarray
    band: np.ndarray
    own: np.ndarray
    columns: dict[str, pa.Array]


@dataclass
class Stack:
    """Some whole bands in one grid, one above the other, as many empty rows between them as a pass may look. ``d``: each band's design."""

    d: pa.Array
    shape: tuple[int, int]
    sides: list[Side]


def steps_of(values: np.ndarray) -> np.ndarray:
    """Differences from value to value, in the smallest type that holds them."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    low, high = (int(e) for e in (steps.min(), steps.max()))
    return steps.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def numbered(rows: pa.RecordBatch, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Those columns whose values together are few, the number of each row's values, and a row that holds each number's."""
    n, few, code, count = rows.num_rows, [], np.zeros(rows.num_rows, np.int64), 1
    for c in names:
        each = rows.column(c).dictionary_encode(null_encoding="encode")
        if len(each.dictionary) > max(FEW, n // 4):
            continue
        if len(each.dictionary) > 1:
            both = each if count == 1 else pa.array(code * len(each.dictionary) + each.indices.to_numpy()).dictionary_encode()
            if len(both.dictionary) > max(FEW, n // 4):
                continue
            code, count = both.indices.to_numpy().astype(np.int64), len(both.dictionary)
        few.append(c)
    first = np.zeros(count, np.int64)
    first[code] = np.arange(n)
    return few, code.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if count <= np.iinfo(t).max + 1)), first


def squeezed(rows: pa.RecordBatch, codec: pa.Codec) -> bytes:
    """Rows as compressed bytes, after the length they have when loose: x and y as steps, columns of few values together once, as a table and numbers.

    A byte a column says how it is held: 0 as it is, 9 in the table, else the bytes of a step; one more has those of a number.
    """
    kinds = {c: rows.column(c).type for c in rows.schema.names}
    steps = {c: steps_of(rows.column(c).to_numpy()) for c in "xy" if c in kinds and pa.types.is_integer(kinds[c]) and not rows.column(c).null_count}
    plain = [c for c, k in kinds.items() if c not in steps and (pa.types.is_integer(k) or pa.types.is_boolean(k) or pa.types.is_string(k))]
    few, code, first = numbered(rows, plain)
    held = [pa.array(steps[c]) if c in steps else rows.column(c) for c in kinds if c not in few]
    parts = [pa.RecordBatch.from_arrays([pa.array(code), *held], names=list(map(str, range(len(held) + 1)))).serialize()]
    at = pa.array(first)
    parts.append(pa.RecordBatch.from_arrays([rows.column(c).take(at) for c in few], names=few).serialize() if few else b"")
    how = bytes(steps[c].itemsize if c in steps else 9 if c in few else 0 for c in kinds) + bytes([code.itemsize])
    data = b"".join(bytes(p) + bytes(-len(p) % 64) for p in (how, *parts))
    return len(data).to_bytes(8, "little") + parts[0].size.to_bytes(8, "little") + codec.compress(data, asbytes=True)


def loose(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    """The rows that were squeezed."""
    every = pa.Codec(CODEC).decompress(data[16:], int.from_bytes(data[:8], "little"))
    how, size = every.slice(0, len(schema) + 1).to_pybytes(), int.from_bytes(data[8:16], "little")
    number = {1: pa.uint8(), 2: pa.uint16(), 4: pa.uint32()}[how[-1]]
    step = {1: pa.int8(), 2: pa.int16(), 4: pa.int32(), 8: pa.int64()}
    kinds = [number] + [step.get(h, f.type) for h, f in zip(how, schema, strict=False) if h != 9]
    at = len(how) + -len(how) % 64
    code, *held = pa.ipc.read_record_batch(every.slice(at, size), pa.schema([(str(i), k) for i, k in enumerate(kinds)])).columns
    few = pa.schema([f for h, f in zip(how, schema, strict=False) if h == 9])
    table = pa.ipc.read_record_batch(every.slice(at + size + -size % 64), few).take(code).columns if len(few) else []
    columns = []
    for h, f in zip(how, schema, strict=False):
        column = (table if h == 9 else held).pop(0)
        columns.append(pa.array(np.cumsum(column.to_numpy(), dtype=np.int64)).cast(f.type) if h in step else column)
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def packed(raster: DataFrame, halo: int = 0, rows: int = ROWS, side: int = 0) -> DataFrame:
    """``raster`` (d, x, y, ...; plain types) as d, _band, _side, _n (pixels), _data; rows within ``halo`` of a band's edge are in the next band too."""
    kinds, rest = dict(raster.dtypes), [c for c in raster.columns if c != "d"]
    at_y, high = rest.index("y") + 1, max(rows, halo + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC)
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            y = batch.column(at_y).to_numpy().astype(np.int64)
            band = own = y // high
            at = np.arange(len(y))
            up, low = np.flatnonzero((y - halo) // high != own), np.flatnonzero((y + halo) // high != own)
            mine = at < len(y)
            if len(up) or len(low):
                at, band = np.concatenate([at, up, low]), np.concatenate([own, own[up] - 1, own[low] + 1])
                mine = np.arange(len(at)) < len(y)
            code = code[at]
            if ((code[1:] < code[:-1]) | ((code[1:] == code[:-1]) & (band[1:] < band[:-1]))).any():
                order = np.lexsort((band, code))
                at, band, mine, code = at[order], band[order], mine[order], code[order]
            columns = batch.columns[1:]
            if len(at) != len(y) or (at[1:] < at[:-1]).any():
                columns = [c.take(pa.array(at)) for c in columns]
            there = pa.RecordBatch.from_arrays([*columns, pa.array(mine)], names=[*rest, "_own"])
            cut = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (band[1:] != band[:-1])) + 1, [len(at)]])
            data = [squeezed(there.slice(a, b - a), codec) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            first = cut[:-1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[first])), pa.array(band[first], pa.int64()), pa.array(np.full(len(first), side, np.int32)), pa.array(np.diff(cut), pa.int32()), pa.array(data, pa.binary())], names=["d", "_band", "_side", "_n", "_data"])

    return raster.select("d", *rest).mapInArrow(pack, f"d {kinds['d']}, _band long, _side int, _n int, _data binary")


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` (plain types) written once, a compressed batch a row, and read from there: as ``cut``, in a fraction of its bytes."""
    names, kinds = rows.columns, dict(rows.dtypes)
    schema = pa.schema([(c, KINDS[kinds[c]]) for c in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([squeezed(pa.RecordBatch.from_arrays(batch.columns, names=names), codec)], pa.binary())], names=["_data"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (loose(data, schema) for data in batch.column(0).to_pylist())

    return cut(rows.mapInArrow(pack, "_data binary")).mapInArrow(unpack, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def schema_of(raster: DataFrame) -> pa.Schema:
    """The types of a raster's packed columns."""
    return pa.schema([(c, KINDS[k]) for c, k in raster.dtypes if c != "d"] + [("_own", pa.bool_())])


def stack_of(held: list[list[tuple]], kind: pa.DataType, schemas: list[pa.Schema], gap: int) -> Iterator[Stack]:
    """The stack of some bands, each a list of (d, side, data); several stacks where wide and narrow designs would make one of holes."""
    parts: list[list[pa.RecordBatch]] = [[] for _ in schemas]
    bands: list[list[int]] = [[] for _ in schemas]
    for i, band in enumerate(held):
        for _, side, data in band:
            parts[side].append(loose(data, schemas[side]))
            bands[side].append(i)
    n = len(held)
    low, high, left, right = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), [], []
    tables = [pa.Table.from_batches(p, schema=s).combine_chunks() for p, s in zip(parts, schemas, strict=True)]
    places = []
    for part, of, table in zip(parts, bands, tables, strict=True):
        band = np.repeat(np.array(of, np.int64), [b.num_rows for b in part])
        x, y = (table.column(c).to_numpy().astype(np.int64) for c in "xy")
        if len(y):
            starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            low[band[starts]] = np.minimum(low[band[starts]], np.minimum.reduceat(y, starts))
            high[band[starts]] = np.maximum(high[band[starts]], np.maximum.reduceat(y, starts))
            left.append(x.min())
            right.append(x.max())
        places.append((band, x, y))
    tall = high - low + 1 + gap
    shape = int(tall.sum()), int(max(right) - min(left)) + 1
    if n > 1 and shape[0] * shape[1] > CELLS:
        yield from stack_of(held[: n // 2], kind, schemas, gap)
        yield from stack_of(held[n // 2 :], kind, schemas, gap)
        return
    base = np.concatenate([[0], np.cumsum(tall)[:-1]]) - low
    sides = []
    for (band, x, y), table in zip(places, tables, strict=True):
        columns = {c: table.column(c).combine_chunks() for c in table.column_names}
        sides.append(Side(y + base[band], x - min(left), band, columns.pop("_own").to_numpy(zero_copy_only=False), columns))
    yield Stack(pa.array([band[0][0] for band in held], kind), shape, sides)


def over_bands(rasters: list[DataFrame], halo: int, look: Callable[[Stack], pa.RecordBatch], schema: str, rows: int = ROWS) -> DataFrame:
    """What ``look`` makes of all bands of the rasters (of the same designs), stack by stack: rows of ``schema``. Each raster is shuffled once, packed."""
    return over_packed([packed(r, halo, rows, i) for i, r in enumerate(rasters)], rasters, halo, look, schema)


def over_packed(parts: list[DataFrame], rasters: list[DataFrame], halo: int, look: Callable[[Stack], pa.RecordBatch], schema: str, together: int = TOGETHER) -> DataFrame:
    """As ``over_bands``, of rasters that are packed already (``parts``, one a side, of the same height of bands). ``together``: pixels of a stack, about."""
    both = reduce(DataFrame.unionByName, parts)
    kind, schemas, gap = KINDS[dict(rasters[0].dtypes)["d"]], [schema_of(r) for r in rasters], max(halo, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        last, size = None, 0
        for batch in batches:
            for d, band, side, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (d, band):
                    if size >= together:
                        yield from map(look, stack_of(held, kind, schemas, gap))
                        held, size = [], 0
                    last = d, band
                    held.append([])
                held[-1].append((d, side, data))
                size += n
        if held:
            yield from map(look, stack_of(held, kind, schemas, gap))

    return both.repartition("d", "_band").sortWithinPartitions("d", "_band").mapInArrow(run, schema)


def out_schema(raster: DataFrame, keep: list[str], makes: dict[str, str]) -> str:
    """d, x, y and ``keep`` with their types, and new columns."""
    kinds = dict(raster.dtypes)
    return ", ".join([f"`{c}` {kinds[c]}" for c in ("d", "x", "y", *keep)] + [f"`{c}` {t}" for c, t in makes.items()])


def matched(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` and the columns of ``b`` beside d, x, y, joined on them (``how``: inner or left). Rasters: ``b`` holds a pixel once."""
    mine, other = ([c for c in t.columns if c not in ("d", "x", "y")] for t in (a, b))
    kinds = dict(b.dtypes)
    schema = out_schema(a, mine, {c: kinds[c] for c in other})

    def look(stack: Stack) -> pa.RecordBatch:
        p, q = stack.sides
        at = np.full(stack.shape, -1, np.int64)
        at[q.row, q.x] = np.arange(len(q.row))
        to = at[p.row, p.x]
        rows = np.arange(len(to)) if how == "left" else np.flatnonzero(to >= 0)
        to = pa.array(to[rows], mask=to[rows] < 0)
        rows_ = pa.array(rows)
        arrays = [stack.d.take(pa.array(p.band[rows])), *(p.columns[c].take(rows_) for c in ("x", "y", *mine)), *(q.columns[c].take(to) for c in other)]
        return pa.RecordBatch.from_arrays(arrays, names=["d", "x", "y", *mine, *other])

    return over_bands([a, b.select("d", "x", "y", *other)], 0, look, schema)


def with_facts(raster: DataFrame, facts: DataFrame) -> DataFrame:
    """``raster`` joined with one row of ``facts`` (d and others) a design; packed pixels are shuffled, whatever the number of designs."""
    rest, kinds = [c for c in raster.columns if c != "d"], dict(raster.dtypes)
    more = [c for c in facts.columns if c != "d"]
    schema = schema_of(raster)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                pixels = loose(data, schema)
                same = pa.array(np.full(pixels.num_rows, i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), *pixels.columns[:-1], *(c.take(same) for c in batch.columns[2:])], names=["d", *rest, *more])

    found = dict(facts.dtypes)
    kind = ", ".join([f"`{c}` {kinds[c]}" for c in ("d", *rest)] + [f"`{c}` {found[c]}" for c in more])
    return packed(raster).select("d", "_data").join(facts, "d").select("d", "_data", *more).mapInArrow(unpack, kind)


def by_colour(pixels: DataFrame, facts: DataFrame) -> DataFrame:
    """``pixels`` (d, x, y, rgb, ...) with what is known of their design's colours (``facts``: d, rgb, ...; plain types, one row a colour), null elsewhere.

    Packed pixels meet their design's colours, gathered in one row as any palette is: no pixel is shuffled as a row, whatever the number of colours.
    """
    rest, kinds, found = [c for c in pixels.columns if c != "d"], dict(pixels.dtypes), dict(facts.dtypes)
    more = [c for c in facts.columns if c not in ("d", "rgb")]
    lists = facts.where("rgb is not null").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("rgb", *more))).alias("_facts"))
    schema = schema_of(pixels)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, ends = batch.column(2), np.asarray(batch.column(2).offsets)
            flat = every.values
            known, values = flat.field(0).to_numpy(), [flat.field(i + 1) for i in range(len(more))]
            there = every.is_valid().to_numpy(zero_copy_only=False)
            for i, data in enumerate(batch.column(1).to_pylist()):
                p = loose(data, schema)
                rgb = p.column(rest.index("rgb"))
                first, last = (int(ends[i]), int(ends[i + 1])) if there[i] else (0, 0)
                asked = rgb.fill_null(-1).to_numpy()
                at = np.searchsorted(known[first:last], asked) + first
                hit = (at < last) & rgb.is_valid().to_numpy(zero_copy_only=False)
                hit[hit] = known[at[hit]] == asked[hit]
                to = pa.array(np.where(hit, at, 0), mask=~hit)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(p.num_rows, i))), *p.columns[:-1], *(v.take(to) for v in values)], names=["d", *rest, *more])

    kind = ", ".join([f"`{c}` {kinds[c]}" for c in ("d", *rest)] + [f"`{c}` {found[c]}" for c in more])
    return packed(pixels).select("d", "_data").join(lists, "d", "left").mapInArrow(look, kind)
