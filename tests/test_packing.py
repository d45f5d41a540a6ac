"""Rasters packed for shuffles."""

from __future__ import annotations

import random

from heddle.operators import packing, raster, reduce, repeats


def noise(spark, names, seed=1, parts=3):
    """Random rasters, one of them many bands high, with a short last row; rows in any order."""
    rnd = random.Random(seed)
    rows = [(d, x, y, rnd.choice([0, 1, 2, None])) for d, (w, h) in names.items() for y in range(h) for x in range(w - (y == h - 1))]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, f"d {'string' if isinstance(rows[0][0], str) else 'long'}, x int, y int, ink int").repartition(parts)


def test_packed_rows_are_few_and_whole(spark):
    rows, t = noise(spark, {1: (5, 40), 2: (64, 300)})
    p = packing.packed(t).collect()
    assert sum(r._n for r in p) == len(rows) and len(p) <= 3 * (1 + 3)
    assert {(r.d, r._band) for r in p} == {(1, 0), (2, 0), (2, 1), (2, 2)}


def test_rasters_match_on_pixels(spark):
    rows, a = noise(spark, {"a": (5, 40), "b": (17, 300)})
    other = {(d, x, y): i for i, (d, x, y, _) in enumerate(rows) if i % 3}
    b = spark.createDataFrame([(*k, v) for k, v in other.items()], "d string, x int, y int, v long")
    got = {(r.d, r.x, r.y): (r.ink, r.v) for r in packing.matched(a, b).collect()}
    assert got == {(d, x, y): (ink, other[d, x, y]) for d, x, y, ink in rows if (d, x, y) in other}
    left = {(r.d, r.x, r.y): (r.ink, r.v) for r in packing.matched(a, b, "left").collect()}
    assert left == {(d, x, y): (ink, other.get((d, x, y))) for d, x, y, ink in rows}


def test_facts_of_designs_reach_their_pixels(spark):
    rows, t = noise(spark, {1: (5, 40), 2: (3, 300)})
    got = packing.with_facts(t, spark.createDataFrame([(1, 7), (3, 9)], "d long, w int")).collect()
    assert sorted((r.x, r.y, r.ink is None, r.w) for r in got) == sorted((x, y, ink is None, 7) for d, x, y, ink in rows if d == 1)


def test_neighbours_in_stacked_bands(spark):
    rows, t = noise(spark, {1: (5, 40), 2: (64, 700), 3: (1, 1)})
    ink = {r[:3]: r[3] for r in rows}
    for r in raster.neighbours(t).collect():
        for name, (dy, dx) in raster.OFFSETS.items():
            want = ink.get((r.d, r.x + dx, r.y + dy)) if (r.d, r.x, r.y + dy) in ink else None
            assert r[name] == want, (r, name)


def test_pixels_are_shuffled_packed(spark):
    """No pass over neighbours, and no join of rasters, sorts or shuffles pixels as rows."""
    _, t = noise(spark, {1: (64, 64)})
    for df in (raster.neighbours(t), raster.local_range(t, "ink"), raster.morph(t, 1, "open"), raster.runs(t), packing.matched(t, t.withColumnRenamed("ink", "o"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line or "Sort [" in line]
        assert exchanges and all("d" in line for line in exchanges) and "Window" not in plan and "SortMergeJoin" not in plan
        assert "_data" in plan


def test_edges_that_shifts_bring_onto_each_other(spark):
    """Against brute force, over bands' ends and with designs beside each other."""
    from heddle.operators import repeats

    rnd = random.Random(3)
    size = {1: (9, 140), 2: (6, 7)}
    sides = [{(d, x, y): rnd.choice([0, 1]) for d, (w, h) in size.items() for y in range(h) for x in range(w)} for _ in "ab"]
    edges = [{(d, x, y) for (d, x, y), v in s.items() if s.get((d, x - 1, y), v) != v or s.get((d, x, y - 1), v) != v} for s in sides]
    a, b = (spark.createDataFrame([(*k, v) for k, v in s.items()], "d long, x int, y int, v int") for s in sides)
    got = {(r.d, r.dx, r.dy): (r.n, r.m) for r in repeats.edge_hits(a, b, 2).collect()}
    for d in size:
        assert got[d, None, None] == tuple(sum(k[0] == d for k in e) for e in edges)
        for dx in range(-2, 3):
            for dy in range(-2, 3):
                assert got[d, dx, dy][0] == sum(k == d and (k, x + dx, y + dy) in edges[1] for k, x, y in edges[0])


def test_halves_round_as_the_scaled_double(spark):
    from heddle.functions.print_rules import rounded

    row = spark.sql("select 1.005e0 as a, 2.5e0 as b, -2.5e0 as c").select(rounded("a", 2), rounded("b", 0), rounded("c", 0)).first()
    assert tuple(row) == (1.0, 3.0, -3.0)


def shuffled_plan(spark, make):
    """The plan of ``make()`` as at size: nothing is broadcast for being small."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_colours_reach_packed_pixels(spark):
    rows, t = noise(spark, {"a": (5, 40), "b": (17, 300), "c": (2, 2)})
    t = t.withColumnRenamed("ink", "rgb")
    facts = spark.createDataFrame([("a", 0, 7, True), ("a", 2, 8, False), ("b", 1, 9, None), ("z", 1, 1, True)], "d string, rgb int, ink int, exact boolean")
    known = {(r.d, r.rgb): (r.ink, r.exact) for r in facts.collect()}
    got = {(r.d, r.x, r.y): (r.rgb, r.ink, r.exact) for r in packing.by_colour(t, facts).collect()}
    assert got == {(d, x, y): (v, *known.get((d, v), (None, None))) for d, x, y, v in rows}
    joins = [line for line in shuffled_plan(spark, lambda: packing.by_colour(t, facts)).splitlines() if "Join" in line]
    assert joins and all("rgb" not in line for line in joins)


def test_kept_rows_are_written_compressed(spark, tmp_path):
    import os

    from heddle.operators import graph

    t = spark.range(100_000).selectExpr("id div 4096 as d", "cast(id % 64 as int) as x", "cast(id div 64 % 64 as int) as y", "cast(id % 7 as int) as rgb", "id % 3 = 0 as edge")
    folder = lambda: spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder()) for f in files)
    graph.cut(spark.range(1))
    start = size()
    plain = graph.cut(t)
    middle = size()
    small = packing.kept(t)
    assert size() - middle < (middle - start) / 5
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, plain.collect()))


def test_nearest_over_many_bands(spark):
    """Against brute force, with columns whose mask pixels lie bands away; no pixel is sorted as a row."""
    from pyspark.sql import functions as F

    from heddle.operators import distance

    rnd = random.Random(5)
    size = {1: (4, 700), 2: (7, 60), 3: (3, 300)}
    rows = [(d, x, y, int(rnd.random() < 0.004 and d < 3)) for d, (w, h) in size.items() for y in range(h) for x in range(w - (y == h - 1))]
    t = spark.createDataFrame(rows, "d long, x int, y int, m int").repartition(5)
    got = {(r.d, r.x, r.y): (r.near, r.far2) for r in distance.nearest(t.withColumn("v", F.expr("x * 1000 + y")), F.col("m") == 1, "v").collect()}
    mask = {d: [(x, y) for e, x, y, m in rows if e == d and m] for d in size}
    for d, x, y, _ in rows:
        best = min((((x - a) ** 2 + (y - b) ** 2, b, a) for a, b in mask[d]), default=None)
        assert got[d, x, y] == (None if best is None else best[2] * 1000 + best[1], None if best is None else best[0])
    plan = shuffled_plan(spark, lambda: distance.nearest(t, F.col("m") == 1, "x"))
    assert "_data" in plan and all("_band" in line for line in plan.splitlines() if "Window [" in line)


def test_votes_of_neighbour_inks_are_counted_on_bands(spark):
    """Against brute force; no expression compares the eight columns of neighbours pair by pair."""
    from heddle.operators import fringe

    rows, t = noise(spark, {1: (5, 40), 2: (17, 300)})
    inks = spark.createDataFrame([(i, 90 * i, 0, 0) for i in range(3)], "ink int, pr int, pg int, pb int")
    ink = {r[:3]: r[3] for r in rows}
    t = t.selectExpr("*", "100 as r", "0 as g", "0 as b")
    got = {(r.d, r.x, r.y): r.other for r in fringe.unmix_edges(t, inks).collect()}
    assert set(got) == {k for k, v in ink.items() if v is not None}
    for (d, x, y), other in got.items():
        near = [ink.get((d, x + dx, y + dy)) for dy, dx in raster.OFFSETS.values() if (d, x, y + dy) in ink]
        best = max(((near.count(v), -v) for v in set(near) if v is not None and v != ink[d, x, y]), default=None)
        assert other == (None if best is None else -best[1])
    assert "nw#" not in fringe.unmix_edges(t, inks)._jdf.queryExecution().executedPlan().toString()


def test_regions_over_seams_of_bands(spark):
    """Against a flood fill, also diagonally; inside bands no touching runs are edges of the graph."""
    from pyspark.sql import functions as F

    from heddle.operators import graph, regions

    rnd = random.Random(9)
    size = {1: (6, 700), 2: (9, 40), 3: (1, 1)}
    ink = {(d, x, y): rnd.choice([0, 0, 1, -1]) if y % 90 else 0 for d, (w, h) in size.items() for y in range(h) for x in range(w - (y == h - 1 and w > 1))}
    t = spark.createDataFrame([(*k, v) for k, v in ink.items()], "d long, x int, y int, ink int").repartition(4)
    sent, plain = [], graph.components
    graph.components = lambda edges: sent.append(edges.count()) or plain(edges)
    try:
        for eight in (False, True):
            label = {}
            for start in ink:
                todo = [start] if ink[start] >= 0 and start not in label else []
                while todo:
                    d, x, y = k = todo.pop()
                    if k in label:
                        continue
                    label[k] = start
                    ways = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if abs(i) + abs(j) == 1 or eight and i and j]
                    todo += [n for i, j in ways if ink.get(n := (d, x + i, y + j)) == ink[k]]
            got = {(r.d, r.x, r.y): r.region for r in regions.labelled_runs(t, eight).select("d", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "region").collect()}
            assert set(got) == set(label)
            assert len({(label[k], got[k]) for k in got}) == len(set(label.values())) == len(set(got.values()))
    finally:
        graph.components = plain
    assert max(sent) < len(ink) / 40


def test_facing_areas_on_bands(spark):
    """Runs of areas give what their pixels give, over many bands; no window sorts pixels."""
    from pyspark.sql import functions as F

    from heddle.operators import areas, regions

    rnd = random.Random(4)
    rows = [(1, x, y, rnd.choice([0, -1, -1])) for y in range(400) for x in range(12)]
    t = spark.createDataFrame(rows, "d long, x int, y int, ink int")
    runs = regions.labelled_runs(t)
    region = {(r.x, r.y): r.region for r in runs.select("y", F.explode(F.sequence("x0", "x1")).alias("x"), "region").collect()}
    want = set()
    for (x, y), a in region.items():
        for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
            line = [(x + k * dx, y + k * dy) for k in range(1, 6)]
            line = [region.get(p) for p in line if 0 <= p[0] < 12 and 0 <= p[1] < 400]
            b = next((v for v in line if v is not None), None)
            if line and line[0] is None and b is not None and b != a:
                want.add((1, min(a, b), max(a, b)))
    pixels = t.select("d", "x", "y").join(runs.select("d", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "region"), ["d", "x", "y"], "left")
    for found in (areas.facing(pixels, 5), areas.facing(t.select("d", "x", "y"), 5, runs)):
        assert {tuple(r) for r in found.collect()} == want
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_squeezed_rows_come_back(spark):
    """Places in any order and of any size, nulls, columns of many and of few values, and pieces of batches."""
    import numpy as np
    import pyarrow as pa

    rnd, n, codec = np.random.default_rng(5), 3000, pa.Codec(packing.CODEC)
    ends = np.iinfo(np.int64)
    few, name = pa.array([None if i % 7 == 0 else i % 5 for i in range(n)], pa.int32()), pa.array([None if i % 9 == 0 else f"s{i % 11}" for i in range(n)])
    cases = [
        {"x": rnd.integers(0, 64, n).astype(np.int32), "y": rnd.integers(0, 99, n).astype(np.int32), "ink": few, "_own": np.ones(n, bool)},
        {"x": rnd.integers(ends.min, ends.max, n), "y": np.arange(n) // 64, "v": rnd.integers(ends.min, ends.max, n), "w": rnd.random(n), "name": name, "_own": rnd.random(n) < 0.5},
        {"y": few, "u": np.arange(n) % 700, "none": pa.array([None] * n, pa.int32()), "w": np.where(np.arange(n) % 2, -0.0, np.nan)},
    ]
    for case in cases:
        batch = pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in case.items()})
        for part in (batch, batch.slice(5, 1000), batch.slice(n - 1)):
            back = packing.loose(packing.squeezed(part, codec), batch.schema)
            back.validate(full=True)
            assert str(back.to_pydict()) == str(part.to_pydict()) and back.schema == part.schema


def test_columns_that_say_the_same_are_packed_once(spark):
    """A pixel of three channels, ink and a mark that follow from one sign takes hardly more bytes than the sign."""
    from heddle.plans import fixtures

    chars = fixtures.chars(spark, "/root/testdata/sf0.001").cache()
    five = chars.selectExpr("d", "x", "y", *[f"{e} as {c}" for c, e in fixtures.RGB.items()], f"{fixtures.INK} as ink", "cp % 2 = 0 as kept")
    one, all_ = (packing.packed(t, 1, 256).selectExpr("sum(length(_data)) as b").first().b for t in (chars, five))
    assert all_ < 1.25 * one and all_ < 1.2 * chars.count()


def test_hairlines_on_bands(spark):
    """A line over many bands comes back whole, in designs of few and of many colours, and no pixel is sorted or shuffled as a row."""
    ground = {1: lambda x, y: (240, 250, 200), 2: lambda x, y: (240 + x, 250 - y // 6, 200 + x * y % 8)}
    rows = [(d, x, y, *((0, 0, 0) if x == 5 else ground[d](x, y))) for d in ground for y in range(300) for x in range(12 - 4 * (y == 299))]
    assert len({r[3:] for r in rows if r[0] == 2}) > 1024
    line = spark.createDataFrame(rows, "d long, x int, y int, r int, g int, b int")
    flat = line.selectExpr("d", "x", "y", "200 as r", "200 as g", "200 as b")
    found = reduce.keep_hairlines(line, flat)
    got = {(r.d, r.x, r.y) for r in found.where("r = 0").collect()}
    assert got == {(d, 5, y) for d in ground for y in range(1, 299)}  # the ends have one neighbour on the line
    assert found.count() == len(rows)
    plan = shuffled_plan(spark, lambda: reduce.keep_hairlines(line, flat))
    assert "Window" not in plan and "Join" not in plan and "_data" in plan


def test_signatures_on_bands(spark):
    """A motif met again far below has one signature in both places, over seams of bands; pixels are neither sorted nor shuffled as rows."""
    rnd = random.Random(3)
    motif = [[rnd.randrange(256) for _ in range(16)] for _ in range(16)]
    rows = [(d, x, y, motif[(y - 120) % 140][x - 3] if 3 <= x < 19 and (y - 120) % 140 < 16 and y >= 120 else rnd.randrange(256)) for d in "ab" for y in range(300) for x in range(24)]
    t = spark.createDataFrame(rows, "d string, x int, y int, g int")
    found = repeats.signatures(t, flat=1.0)
    sigs = {(r.d, r.x, r.y): (r.sig, r.mirrored) for r in found.collect()}
    assert {k[1:] for k in sigs} <= {(x, y) for x in range(9) for y in range(285)}
    assert sigs["a", 3, 120] == sigs["b", 3, 120] == sigs["a", 3, 260]
    cells = [sum(motif[4 * j + v][4 * i + u] for u in range(4) for v in range(4)) for j in range(4) for i in range(4)]
    off = [16 * c - sum(cells) for c in cells]
    signs = [1 + (32 * o > sum(map(abs, off))) - (32 * o < -sum(map(abs, off))) for o in off]
    number = lambda order: int("".join(str(signs[k]) for k in order), 3)
    assert sigs["a", 3, 120] == (number(range(16)), number([4 * j + i for j in range(4) for i in (3, 2, 1, 0)]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_data" in plan


def test_regions_are_summed_up_in_bands(spark):
    """Low and tall designs give what their runs give, and only parts of regions over seams are shuffled."""
    from heddle.operators import regions

    rows, t = noise(spark, {"a": (7, 40), "b": (9, 400), "c": (3, 128), "d": (2, 300)})
    t = t.unionByName(spark.createDataFrame([("e", 3, y, 5) for y in range(700)], "d string, x int, y int, ink int"))
    for eight in (False, True):
        found = regions.region_sums(t, eight, {"right": ("long", lambda runs: runs.x1 - runs.x0), "m": ("double", lambda runs: runs.y * 0.5)})
        runs = regions.labelled_runs(t, eight)
        names = ["d", "ink", "region", "area", "x0", "x1", "y0", "y1", "top_x"]
        want = {tuple(r) for r in regions.bounds(runs).select(*names).collect()}
        assert {tuple(r) for r in found.select(*names).collect()} == want == {tuple(r) for r in regions.regions(t, eight).select(*names).collect()}
        more = {(r.d, r.region): (r.n, r.m) for r in runs.groupBy("d", "region").agg({"x1": "sum", "x0": "sum", "y": "sum"}).selectExpr("d", "region", "`sum(x1)` - `sum(x0)` as n", "`sum(y)` / 2 as m").collect()}
        assert {(r.d, r.region): (r.right, r.m) for r in found.collect()} == more
    plan = shuffled_plan(spark, lambda: regions.regions(t))
    assert not any("Exchange" in line and "region#" in line for line in plan.splitlines())


def test_shapes_of_tall_designs(spark):
    """Holes are counted over seams, shapes of one design share letters wherever they lie, and areas reach their design packed."""
    from heddle.operators import shapes

    ring = lambda x, y: 0 <= x < 5 and 0 <= y < 5 and not (1 <= x < 4 and 1 <= y < 4)
    cells = {(x, y): 1 if any(ring(x - 1, y - top) for top in (3, 126, 290)) else 2 if 2 <= x < 5 and 200 <= y < 203 else -1 for x in range(8) for y in range(300)}
    t = spark.createDataFrame([("a", x, y, i) for (x, y), i in cells.items()], "d string, x int, y int, ink int")
    found = shapes.shape_numbers(t)
    got = {(r.y0, r.top_x): r for r in found.collect()}
    assert {k: (r.area, r.holes, r.cx, r.cy) for k, r in got.items()} == {(3, 1): (16, 1, 3.0, 5.0), (126, 1): (16, 1, 3.0, 128.0), (290, 1): (16, 1, 3.0, 292.0), (200, 2): (9, 0, 3.0, 201.0)}
    grouped = shapes.group_shapes(found)
    letter = {r.region: r.letter for r in grouped.collect()}
    assert {k: letter[r.region] for k, r in got.items()} == {(3, 1): "A", (126, 1): "A", (290, 1): "A", (200, 2): "B"}
    plan = shuffled_plan(spark, lambda: shapes.group_shapes(found))
    assert "Window" not in plan and not any("Exchange" in line and "region#" in line for line in plan.splitlines())


def test_inks_that_face_each_other_on_bands(spark):
    """The next inked pixel of a row, by hand; pixels are neither sorted nor shuffled as rows."""
    from heddle.operators import detail

    rows, t = noise(spark, {"a": (30, 40), "b": (9, 300)})
    cells, want = {(d, x, y): i for d, x, y, i in rows}, {}
    for (d, x, y), ink in cells.items():
        nxt = next((v for v in range(x + 1, 30) if (cells.get((d, v, y)) or 0) > 0), None) if (ink or 0) > 0 else None
        if nxt is not None and 1 <= nxt - x - 1 <= 4:
            want[d, ink, cells[d, nxt, y]] = want.get((d, ink, cells[d, nxt, y]), 0) + 1
    found = detail.facing(t, reach=4)
    assert {(r.d, r.a, r.b): r.n for r in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_line_inks_on_bands(spark):
    """A blurred line over many bands leads to its ink, each design by its own inks; inks and pixels meet packed."""
    from heddle.operators import ridges

    cream, dark, sage = (240, 230, 205), (20, 20, 25), (130, 125, 115)
    rows = [(d, x, y, *(sage if x == 8 else cream), 2 if x == 8 else 0) for d in "ab" for y in range(300) for x in range(18)]
    pixels = spark.createDataFrame(rows, "d string, x int, y int, r int, g int, b int, ink int")
    inks = spark.createDataFrame([("a", 0, *cream), ("a", 1, *dark), ("b", 0, *cream)], "d string, ink int, r int, g int, b int")
    found = ridges.line_inks(pixels, inks)
    assert {tuple(r) for r in found.collect()} == {("a", 8, y, 2, 1) for y in range(300)}
    plan = shuffled_plan(spark, lambda: ridges.line_inks(pixels, inks))
    assert "Window" not in plan and not any("Exchange" in line and "x#" in line for line in plan.splitlines())


def test_new_colours_on_bands(spark):
    """Shares of far colours by hand, in low and tall designs; colours aren't shuffled with their differences."""
    rnd = random.Random(6)
    own = {"a": [0x000000, 0xFFFFFF], "b": [0x808080], "c": []}
    rows = [(d, x, y, rnd.choice([0x050505, 0xFF0000, 0x7F8081, 0xFFFFFF])) for d, h in (("a", 300), ("b", 20), ("c", 9)) for y in range(h) for x in range(7)]
    t = spark.createDataFrame(rows, "d string, x int, y int, rgb int")
    far = {"a": {0xFF0000, 0x7F8081}, "b": {0x050505, 0xFF0000, 0xFFFFFF}}
    want = {d: 100 * sum(r[3] in v for r in rows if r[0] == d) / sum(r[0] == d for r in rows) for d, v in far.items()}
    mine = spark.createDataFrame([(d, v) for d, vs in own.items() for v in vs], "d string, rgb int")
    got = repeats.new_colours(t, mine)
    assert {r.d: round(r.new_colours, 9) for r in got.collect()} == {d: round(v, 9) for d, v in want.items()}
    plan = shuffled_plan(spark, lambda: repeats.new_colours(t, mine))
    assert not any("Exchange" in line and "x#" in line for line in plan.splitlines())
