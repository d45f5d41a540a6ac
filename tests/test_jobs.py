"""Jobs on small cases with known answers, and every registered query against its SQL."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle import plans
from heddle.functions import colour, layers, recolour, text
from heddle.functions import print_rules as rules
from heddle.operators import detail, graph, ledger, methods, palette, raster, reduce, regions, score, screens
from heddle.plans import fixtures
from heddle.sources import files
from heddle.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.SQL[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got.select(columns).collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def pixel_count(rows, column):
    """All rows together count each pixel of the smallest tables once."""
    return sum(r[column] for r in rows) == PIXELS


PIXELS = sum(len(t or "") for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall())
OPAQUE = sum(len((t or "").replace("!", "")) for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall())
#: What holds of the rows of queries that SQL can't check.
HOLDS = {
    "k3_merge_to": lambda rows: all(sum(r.d == d for r in rows) <= 4 for d in {r.d for r in rows}),
    "k11_merge_twins": lambda rows: all(sorted(int(i) for r in rows if r.d == d for i in r.inks.split(",")) == list(range(sum(len(r.inks.split(",")) for r in rows if r.d == d))) for d in {r.d for r in rows}),
    "k5_reduce": lambda rows: pixel_count(rows, "pixels") and max(r.ink for r in rows) <= 3 and all((r.r is None) == (r.ink < 0) for r in rows),
    "k4_feature_inks": lambda rows: 0 < sum(r.features for r in rows) < sum(r.edges for r in rows) <= PIXELS,
    "n27_melt_grain": lambda rows: pixel_count(rows, "n") and all(r.ink != -1 or r.to == -1 for r in rows) and any(r.ink != r.to for r in rows),
    "n28_shape_groups": lambda rows: all(r.areas > 0 for r in rows) and {r.d for r in rows} == {r.d for r in rows if r.letter == "A"},
    "n21_repeat_lattice": lambda rows: all((r.type in ("straight", "half-drop")) == (r.w is not None and r.h is not None) for r in rows),
    "k26_solve_tones": lambda rows: all(len(r.tones) == 6 and 0 <= min(r.tones) <= max(r.tones) <= 1 for r in rows) and all(r.back == r.rgb for r in rows if r.rgb == 0xFFFFFF),
    "k10_similar_small": lambda rows: len({(r.d, r.ink) for r in rows}) == len(rows) > 0 and {(r.d, r.joins) for r in rows} <= {(r.d, r.ink) for r in rows if r.joins == r.ink},
    "k10_merge_shades": lambda rows: len({(r.d, r.ink) for r in rows}) == len(rows) > 0 and {(r.d, r.joins) for r in rows} <= {(r.d, r.ink) for r in rows if r.joins == r.ink},
    "k27_candidate_inks": lambda rows: {r.method for r in rows} == {"hue", "vivid"} and all(r.ink < 6 for r in rows) and len({(r.d, r.method, r.rgb) for r in rows}) == len(rows),
    "k13_ref_palette": lambda rows: sum(r.n for r in rows) == OPAQUE and all(r.ink <= 4 for r in rows) and all(0 <= c <= 255 for r in rows for c in (r.r, r.g, r.b)),
    "j3_swap_plan": lambda rows: all(r.de <= 5 for r in rows) and len({(r.d, r.ink) for r in rows}) == len({(r.d, r.shelf) for r in rows}) == len(rows) > 0,
}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_holds(spark, name):
    rows = plans.QUERIES[name](spark, SF).collect()
    assert HOLDS.get(name, len)(rows) or name not in HOLDS


# published pairs of the CIEDE2000 difference
PAIRS = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, 2.5, 0), (50, 0, -2.5), 4.3065), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644)]


def test_delta_e2000(spark):
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b, _) in enumerate(PAIRS)], "i int, llp double, aap double, bbp double, llq double, aaq double, bbq double")
    got = {r.i: r.de for r in layers.add(df, colour.de2000("p", "q")).collect()}
    for i, (_, _, want) in enumerate(PAIRS):
        assert abs(got[i] - want) < 1e-3


def test_money_and_requests(spark):
    df = spark.createDataFrame([(999.0,), (1000.0,), (123456.0,), (12345678.4,)], "v double")
    assert [r[0] for r in df.select(text.money(F.col("v"), "")).collect()] == ["999", "1,000", "1,23,456", "1,23,45,678"]
    none = (None,) * 4
    said = {
        "500 m, 30 inch, 6 inks": (6, 30.0, 500.0, None), "1,50,000 mtr in dots": (None, None, 150000.0, True), "120 colours": none, "no dots, flat": (None, None, None, False), "rose": none, None: none, "": none,
        '30.5" wide, 1,500 meter': (None, 30.5, 1500.0, None), "6.5 inks": none, "tiny dots": none, "0.2 mm dots hata do": none, "safed dots": none, "chhote dots": none, "dots hatao": (None, None, None, False),
        "dots mat karo": (None, None, None, False), "bina white dots": none, "without any dots": (None, None, None, False), "index separation": (None, None, None, True), "flat": (None, None, None, False),
        "flat but dots": (None, None, None, True), "300 inch": none, "1.2.3 m": none, "5 inks 7 inks": (5, None, None, None), "30, inch": none,
    }
    got = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("t", text.parse_request(F.col("t")).alias("r")).select("t", "r.*").collect()
    assert {r.t: (r.inks, r.width_in, r.meters, r.dots) for r in got} == said
    names = spark.createDataFrame([("in/rose_30in_500m_6inks.png",), (".hidden_6inks",), ("a-b",)], "f string")
    assert [tuple(r[0]) for r in names.select(text.parse_request(text.settings_text(F.col("f")))).collect()] == [(6, 30.0, 500.0, None), (6, None, None, None), none]


def test_letters(spark):
    from string import ascii_uppercase as abc

    def spelled(i):
        return ("" if i < 26 else spelled(i // 26 - 1)) + abc[i % 26]

    index = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 10**12, -1]
    got = spark.createDataFrame([(i,) for i in index], "i long").select("i", text.letter(F.col("i")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: spelled(i) if i >= 0 else None for i in index}


def test_recolour_messages(spark):
    inks = spark.createDataFrame([(i, k, h) for i in range(9) for k, h in ((1, "#D84876"), (2, "#284060"), (3, "#F4F0E6"))], "id int, ink int, hex string")
    said = ["1 navy, kapda kala", "pink ko neela", "pink ki jagah #00ff00 and 2 = red", "no. 3: halka hara", "4 navy; sparkle", "1 navy aur 1 laal", "green -> navy", "kapda", None]
    got = recolour.parse_recolour(spark.createDataFrame(list(enumerate(said)), "id int, text string"), inks).collect()
    rows = {i: sorted((r.target, r.hex) for r in got if r.id == i) for i in range(9)}
    assert rows[0] == [("1", "#1B2A4A"), ("cloth", "#141414")] and rows[1] == [("1", "#1F5FBF")] and rows[2] == [("1", "#00FF00"), ("2", "#C8102E")]
    assert rows[3] == [("3", "#8CBF93")]
    assert rows[4] == [("unread", "4 navy"), ("unread", "sparkle")] and rows[5] == [("1", "#C8102E")] and rows[6] == [("unread", "green -> navy")] and rows[7] == [("unread", "kapda")] and rows[8] == []


def test_colours(spark):
    df = spark.createDataFrame([("navy",), ("halka neela kar do",), ("#1b2a4a please",), ("dark red",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(text.lookup_colour(F.col("t"))).collect()] == ["#1B2A4A", "#84A7DC", "#1B2A4A", "#7A1F2B", None]


def test_print_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(rules.dot_area(lit(0.2), lit(300))) == 4 and one(rules.dot_area(lit(None).cast("double"), lit(300))) == 0
    assert [one(rules.dot_pixels(lit(a), lit(b))) for a, b in ((100, 30), (100, 250), (100, 350))] == [1, 2, 4]
    assert [one(rules.dot_verdict(lit(v))) for v in (0.11, 0.12, 0.45, 0.46)] == ["too fine for most mesh", "ok", "ok", "pattern will show"]
    assert [one(rules.mesh(lit(p), lit(n).cast("int"))) for p, n in (("underbase", None), ("TONAL", None), ("halftone", 55), ("tonal", 56), (None, 80))] == ["110-156", "200-230", "230-280", "305-355", "156-230"]
    assert one(rules.ink_grams(lit(3000), lit(3000), lit(300), lit(0.5), lit("spot"))) == 96.8 and one(rules.ink_grams(lit(1), lit(1), lit(300), lit(0.5), lit("foil"))) is None
    assert [one(rules.recommend(lit(g), lit(n))) for g, n in ((0.0799, 9), (0.08, 4), (0.08, 3))] == ["spot", "hybrid", "halftone"]
    assert [one(rules.band(lit(v).cast("double"), rules.ALIGNMENT_BANDS)) for v in (0.85, 0.84, 0.1, None)] == ["good", "low", "very low", None]
    assert [one(rules.channel_colour(lit(n), lit(i))) for n, i in (("2 BROWN 120", 0), ("Gold red", 0), ("plate", 13), (None, 0))] == ["#6B4530", "#C8A13A", "#457B9D", "#E63946"]
    assert one(rules.keywords(lit("A Rose and a LEAF, Mughal"), rules.MOTIFS)) == ["floral", "botanical"] and one(rules.keywords(lit(None).cast("string"), rules.STYLES)) == []
    assert [one(rules.batch_result(lit(c), lit(t))) for c, t in ((0, "STOP"), (1, "a\nSTOP b"), (1, "no STOP"))] == ["OK", "STOP", "CHECK"]


def test_decide(spark):
    rows = [("a", "reduce", 90.0), ("a", "m2", 80.0), ("a", "m1", 80.0), ("b", "reduce", 90.0), ("b", "m1", 70.0), ("c", "reduce", 50.0), ("d", "m1", 60.0)]
    got = {r.design: (r.chosen, r.margin, r.reason) for r in ledger.decide(spark.createDataFrame(rows, "design string, name string, match double")).collect()}
    assert got == {"a": ("m1", -10.0, "fill_close"), "b": ("reduce", -20.0, "fill_far"), "c": ("reduce", None, "no_fill"), "d": ("m1", None, "no_reduce")}


def test_verdicts_of_runs(spark):
    runs = spark.createDataFrame([(1, "a", 0), (2, "a", 100), (3, "a", 100), (4, "b", 5)], "run_id long, name string, t int").selectExpr("run_id", "name", "timestamp_seconds(t * 86400) as time")
    asked = [(10, "a", 0, None), (11, "a", 99, None), (12, "a", 100, None), (13, "a", 500, None), (14, "b", 4, None), (15, "b", 4, 4), (16, "c", 9, None)]
    back = spark.createDataFrame(asked, "feedback_id long, name string, t int, run_id long").selectExpr("feedback_id", "name", "timestamp_seconds(t * 86400) as time", "run_id")
    assert sorted((r.feedback_id, r.run_id) for r in ledger.attach_verdicts(runs, back).collect()) == [(10, 1), (11, 1), (12, 3), (13, 3), (15, 4)]


def test_library_ranks(spark):
    rows = [(i, "approved" if i % 3 else "rejected", f"Client {i % 4}", "d", i * 37 % 11) for i in range(40)]
    kept = spark.createDataFrame(rows, "job_id long, stage string, client string, design string, t int").withColumn("stage_time", F.timestamp_seconds("t"))
    repeats = spark.createDataFrame([(1,), (1,), (2,)], "job_id long")
    got = {r.job_id: (r["rank"], r.repeats) for r in ledger.library(kept, repeats, "client 1", parts=3).collect()}
    want = sorted((-t, i) for i, s, c, _, t in rows if s == "approved" and c == "Client 1")
    assert got == {i: (n + 1, 2 if i == 1 else 0) for n, (_, i) in enumerate(want)}


def test_quote(spark):
    inks = spark.createDataFrame([(1, 50.0, 620.0), (1, 25.0, 450.0)], "job long, coverage double, price double")
    work = spark.createDataFrame([(1, 100.0, 15.0)], "job long, meters double, margin_percent double")
    full, again = ledger.quote(inks, work).first(), ledger.quote(inks, work, screens_ready=True).first()
    assert full.screens == 2 and full.total > again.total and ledger.quote(inks, work, underbase=True).first().screens == 3


def test_job_state_and_stream_agree(spark, tmp_path):
    rows = [(1, "made", 7, "auto_ok", None), (2, "stage", 7, None, "approved"), (3, "stage", 8, None, "approved"), (4, "made", 8, "needs_review", None), (5, "made", 7, "needs_review", None), (6, "stage", 8, None, "rejected")]
    df = spark.createDataFrame(rows, "seq long, event string, job_id long, status string, stage string")
    wide = df.selectExpr("*", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(seq as int)) as time", "'' as client", "'' as design", "0e0 as meters", "0e0 as quote_total", "0e0 as seconds")
    batch = {r.job_id: (r.seq, r.status, r.stage) for r in ledger.job_state(wide).collect()}
    assert batch == {7: (5, "needs_review", None), 8: (4, "needs_review", "rejected")}
    for part in (df.where("seq <= 3"), df.where("seq > 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = jobs.drain(jobs.job_states(stream), str(tmp_path), "update").groupBy("job_id").agg(F.max_by(F.struct("seq", "status", "stage"), "batch").alias("s")).collect()
    assert {r.job_id: tuple(r.s) for r in out} == batch


def test_late_answers(spark, tmp_path):
    hour = 3600
    rows = [(1, "made", 1, None, 0), (2, "stage", 1, "approved", 49 * hour), (3, "stage", 1, "approved", 50 * hour), (4, "made", 2, None, 0), (5, "stage", 2, "sent", hour), (6, "stage", 2, "approved", 49 * hour),
            (7, "made", 3, None, 0), (8, "stage", 3, "sent", hour), (9, "stage", 3, "approved", 15 * 24 * hour), (10, "made", 4, None, 0), (11, "stage", 4, "rejected", 60 * hour), (12, "stage", 5, "approved", 99 * hour)]
    spark.createDataFrame(rows, "seq long, event string, job_id long, stage string, s long").selectExpr("*", "timestamp_seconds(s) as time").coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("seq long, event string, job_id long, stage string, s long, time timestamp").parquet(str(tmp_path / "log"))
    assert sorted(tuple(r) for r in jobs.drain(jobs.late_answers(stream), str(tmp_path)).select("job_id", "seq").collect()) == [(1, 2), (3, 9)]


def test_expiry(spark, tmp_path):
    day = 86400
    parts = [
        [(1, "made", 1, None, 0), (2, "made", 2, None, 0), (3, "stage", 2, "sent", day), (4, "made", 3, None, 0), (5, "stage", 3, "sent", day), (6, "stage", 3, "approved", 2 * day - 1)],
        [(7, "stage", 2, "sent", 10 * day), (8, "made", 9, None, 14 * day)],
        [(9, "made", 10, None, 17 * day)], [(10, "made", 11, None, 17 * day)],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "seq long, event string, job_id long, stage string, s long").selectExpr("*", "timestamp_seconds(s + 1704067200) as time").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("seq long, event string, job_id long, stage string, s long, time timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "log"))
    got = {r.job_id: r["at"] for r in jobs.drain(jobs.expiry(stream), str(tmp_path)).selectExpr("job_id", "unix_seconds(at) - 1704067200 as at").collect()}
    # 1: two days after it was made; 2: fourteen days after it was first sent; 3: decided, so two days again
    assert {k: got.get(k) for k in (1, 2, 3)} == {1: 2 * day, 2: 15 * day, 3: 2 * day} and not {10, 11} & set(got)


def test_settled_files(spark, tmp_path):
    looks = [("a", 5, 1, 1), ("a", 5, 1, 2), ("b", 0, 1, 1), ("b", 0, 1, 2), ("c", 4, 1, 1), ("c", 6, 2, 2), ("c", 6, 2, 3), ("c", 6, 2, 4)]
    df = spark.createDataFrame(looks, "file string, bytes long, mtime long, look long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.drain(jobs.settled(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path))
    assert sorted((r.file, r["size"]) for r in out.collect()) == [("a", 5), ("c", 6)]


def test_logs(spark, tmp_path):
    (tmp_path / "log.csv").write_text("﻿time,event,job_id,inks\n2024-01-01,made,j1,six\n2024-01-02,made,j2,4\n", encoding="utf-8")
    log = files.read_job_log(spark, str(tmp_path / "log.csv"))
    assert log.columns == files.LOG_COLUMNS
    assert [(r.time, r.inks, r.client) for r in log.orderBy("time").collect()] == [("2024-01-01", 0.0, ""), ("2024-01-02", 4.0, "")]
    (tmp_path / "runs.jsonl").write_text('{"half a line\n{"name": "a", "match": 9.5}\n')
    assert [tuple(r) for r in files.read_json_lines(spark, str(tmp_path / "runs.jsonl"), "name string, match double").collect()] == [("a", 9.5)]
    lines = spark.createDataFrame([("Rani Pink 12, #DE1464",), ("#214440 Ink 2",), ("",), ("no colour",)], "line string")
    inks, errors = files.parse_ink_list(lines)
    assert sorted(tuple(r) for r in inks.collect()) == [("Ink 2", "#214440"), ("Rani Pink 12", "#DE1464")] and errors.count() == 1


def test_reports_packages_and_appended_events(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "a.json").write_text('{"job_id": "j1",\n "match": 91.5}')
    (folder / "b.json").write_text('{"job_id": "j2", "match"')
    (folder / "c.json").write_text('{"match": 3}')
    assert [tuple(r) for r in files.read_reports(spark, str(folder), "job_id string, match double").collect()] == [("j1", 91.5)]
    plates = spark.createDataFrame([(1, 0, x, y, 255) for x in range(3) for y in range(2)] + [(1, 1, 5, 5, 90)], "d long, screen int, x int, y int, alpha int")
    files.write_package(plates, spark.createDataFrame([(1, 0, "01_white"), (1, 1, "02_red")], "d long, screen int, stem string"), str(tmp_path / "package"))
    back = spark.read.parquet(str(tmp_path / "package"))
    assert sorted(os.listdir(tmp_path / "package" / "d=1")) == ["stem=01_white", "stem=02_red"] and back.where("stem = '02_red'").select("x", "alpha").first() == (5, 90)
    events = spark.createDataFrame([("=1+1", 2.0, None), ("plain", 3.0, "-x")], "event string, meters double, note string")
    for _ in range(2):
        files.append_events(events, str(tmp_path / "events"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "events"))
    assert rows.count() == 4 and {r.event for r in rows.collect()} == {"'=1+1", "plain"}
    assert sorted({tuple(r) for r in files.read_events(spark, str(tmp_path / "events")).select("event", "note").collect()}) == [("=1+1", ""), ("plain", "-x")]


def bmp(width, height, pixel):
    pad = (4 - width * 3 % 4) % 4
    body = b"".join(b"".join(bytes(reversed(pixel(x, y))) for x in range(width)) + b"\0" * pad for y in reversed(range(height)))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    return head + (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(body).to_bytes(4, "little") + bytes(16) + body


def test_images(spark, tmp_path):
    (tmp_path / "two.bmp").write_bytes(bmp(20, 20, lambda x, y: (0xD8, 0x48, 0x76) if x < 10 else (0x28, 0x40, 0x60)))
    (tmp_path / "bad.bmp").write_bytes(b"not an image")
    good, bad = files.screen_inputs(files.read_images(spark, str(tmp_path)))
    assert (good.count(), [r.reason for r in bad.collect()]) == (1, ["damaged"])
    counts = palette.colour_counts(files.pixels_of(good).withColumnRenamed("design", "d").selectExpr("d", "x", "y", "cast(r as int) r", "cast(g as int) g", "cast(b as int) b", "a"))
    assert sorted((r.rgb, r.n) for r in counts.collect()) == [(0x284060, 200), (0xD84876, 200)]


def grid(spark, rows):
    return spark.createDataFrame([(1, x, y, int(c)) for y, row in enumerate(rows) for x, c in enumerate(row)], "d long, x int, y int, ink int")


def test_regions_and_specks(spark):
    labels = grid(spark, ["0010", "0110", "1000", "0001"])
    four = sorted((r.ink, r.area) for r in regions.regions(labels).where("ink = 1").collect())
    assert four == [(1, 1), (1, 1), (1, 3)]
    eight = sorted((r.ink, r.area) for r in regions.regions(labels, eight=True).where("ink = 1").collect())
    assert eight == [(1, 1), (1, 4)]
    assert [(r.specks, r.pixels) for r in regions.speck_report(regions.regions(labels), 1).where("ink = 1").collect()] == [(2, 2)]


def islands(rows, eight):
    """Regions of a grid by flood fill: ink, area and first pixel."""
    seen, out = set(), []
    at = {(x, y): c for y, row in enumerate(rows) for x, c in enumerate(row)}
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * eight
    for y, row in enumerate(rows):
        for x, c in enumerate(row):
            if (x, y) in seen:
                continue
            todo, found = [(x, y)], {(x, y)}
            while todo:
                u, v = todo.pop()
                for i, j in steps:
                    if at.get(p := (u + i, v + j)) == c and p not in found:
                        found.add(p)
                        todo.append(p)
            seen |= found
            out.append((int(c), len(found), y, x, frozenset(found)))
    return out


@pytest.mark.parametrize(("width", "height", "eight"), [(1, 1, False), (7, 600, False), (200, 40, False), (64, 64, True), (300, 3, True)])
def test_regions_of_any_size(spark, width, height, eight):
    rnd = random.Random(width)
    rows = ["".join(rnd.choice("001") for _ in range(width)) for _ in range(height)]
    labels = grid(spark, rows).selectExpr("'a.png' as d", "x", "y", "ink")
    got = sorted((r.ink, r.area, r.y0, r.top_x) for r in regions.regions(labels, eight).collect())
    assert got == sorted(x[:4] for x in islands(rows, eight))


def test_bars_of_a_wide_design_stay_apart(spark):
    rows = ["1" * 7 + "0" * 189 + "1" * 4, "0" * 200]
    assert sorted(r.area for r in regions.regions(grid(spark, rows)).where("ink = 1").collect()) == [4, 7]


def cleaned(rows, most):
    """Speck cleaning by flood fill, three passes."""
    now = [list(r) for r in rows]
    for _ in range(3):
        moves = []
        for c, area, _, _, cells in islands(["".join(r) for r in now], True):
            if area > most:
                continue
            votes = {}
            for x, y in cells:
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        u, v = x + i, y + j
                        if (u, v) not in cells and 0 <= v < len(now) and 0 <= u < len(now[v]) and now[v][u] != str(c):
                            votes[now[v][u]] = votes.get(now[v][u], 0) + 1
            if votes:
                moves.append((cells, min(votes, key=lambda k: (-votes[k], k))))
        for cells, to in moves:
            for x, y in cells:
                now[y][x] = to
    return ["".join(r) for r in now]


def test_clean_specks(spark):
    rnd = random.Random(4)
    for rows in (["00000", "01000", "00002", "33000"], ["".join(rnd.choice("00001122") for _ in range(30)) for _ in range(20)]):
        got = {(r.x, r.y): str(r.ink) for r in regions.clean_specks(grid(spark, rows), 2).collect()}
        assert ["".join(got[x, y] for x in range(len(rows[0]))) for y in range(len(rows))] == cleaned(rows, 2)


def test_specks_at_a_repeats_edge(spark):
    found = regions.regions(grid(spark, ["1000", "0010", "0000", "0001"]))
    repeat = spark.createDataFrame([(1, 4, 4)], "d long, width int, height int")
    assert [(r.ink, r.specks) for r in regions.speck_report(found, 1, repeat).collect()] == [(1, 1)]


def test_bands_and_halos_change_nothing(spark, monkeypatch):
    """Every pass gives the same in bands of a few rows as in one band."""
    rnd = random.Random(5)
    rows = ["".join(rnd.choice("0122") for _ in range(23)) for _ in range(37)]
    labels = grid(spark, rows)
    pixels = labels.selectExpr("d", "x", "y", "ink", "ink * 70 as r", "ink * 30 + x as g", "y as b", "255 - ink * 60 as a")
    rank = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "ink int, place int")
    passes = {
        "neighbours": lambda: raster.neighbours(labels), "contacts": lambda: raster.contacts(labels), "edges": lambda: raster.edge_share(labels), "range": lambda: raster.local_range(pixels), "blur": lambda: raster.box_blur(pixels, r=3),
        "gradient": lambda: raster.gradient(pixels, ("r", "g", "b")), "base": lambda: raster.underbase(labels), "base 2": lambda: raster.underbase(labels, 2), "trap": lambda: raster.trap(labels, rank), "trap 2": lambda: raster.trap(labels, rank, 2),
        "soft": lambda: raster.soft_edge(pixels), "boundary": lambda: methods.boundary(labels), "thin": lambda: detail.thin_features(pixels), "tiny": lambda: detail.tiny_islands(labels),
    } | {f"{op} {shape}": lambda op=op, shape=shape: raster.morph(labels, 2, op, 2, shape) for op in ("erode", "dilate", "open", "close") for shape in ("square", "cross", "octagon")}
    whole = {k: plain(f().collect()) for k, f in passes.items()}
    monkeypatch.setattr(raster, "BAND", 5)
    for name, f in passes.items():
        assert plain(f().collect()) == whole[name], name


def test_morph_of_a_repeat(spark):
    labels = grid(spark, ["1000", "0000", "0000", "0000"])
    got = {(r.x, r.y) for r in raster.morph(labels, 1, "dilate", 1, "cross", wrap=(4, 4)).where("out = 1").collect()}
    assert got == {(0, 0), (1, 0), (3, 0), (0, 1), (0, 3)}


CREAM, RED, GREEN = (244, 232, 204), (192, 57, 43), (30, 140, 70)


def picture(spark, width, height, at):
    rows = [(1, x, y, *at(x, y), 255) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "d long, x int, y int, r int, g int, b int, a int")


def test_reduce_keeps_thin_lines_and_dots(spark):
    """A column and a row of one pixel keep their inks but for the crossing and the pixels beside it, and so does a single dot; every pixel has one ink."""
    n = 90
    at = lambda x, y: RED if x == n // 5 else GREEN if y == n // 3 else RED if (x, y) == (60, 60) else CREAM
    labels, inks = reduce.reduce(picture(spark, n, n, at), 6)
    colour_of = {r.ink: (r.r, r.g, r.b) for r in inks.collect()}
    got = {(r.x, r.y): colour_of[r.ink] for r in labels.collect()}
    assert len(got) == n * n and set(colour_of.values()) == {CREAM, RED, GREEN}
    assert sum(got[n // 5, y] == RED for y in range(n)) >= n - 2 and sum(got[x, n // 3] == GREEN for x in range(n)) >= n - 3
    assert got[60, 60] == RED and colour_of[0] == CREAM


def test_reduce_gives_blends_no_ink(spark):
    """Shapes with blended rims: the rims go to the inks of the shapes, and transparent pixels to none."""
    def at(x, y):
        t = min(1, max(0, (x - 18) / 3))
        return tuple(round(a + (b - a) * t) for a, b in zip(CREAM, (40, 60, 160), strict=True))

    p = picture(spark, 40, 30, at).withColumn("a", F.when(F.col("y") == 0, 0).otherwise(F.col("a")))
    labels, inks = reduce.reduce(p, 2)
    assert {(r.r, r.g, r.b) for r in inks.collect()} == {CREAM, (40, 60, 160)}
    assert labels.where("ink = -1").count() == 40 and labels.where("y = 0 and ink >= 0").count() == 0 and labels.count() == 1200


def test_merges(spark):
    rgb = [(200, 20, 20), (203, 22, 21), (20, 20, 200), (250, 250, 250), (120, 200, 120)]
    inks = spark.createDataFrame([(1, i, n, *c) for i, (c, n) in enumerate(zip(rgb, (500, 40, 300, 1000, 5), strict=True))], "d long, ink int, n long, r int, g int, b int")
    assert [(r.inks, r.n) for r in reduce.merge_palettes(inks, 8, all_twins=True).orderBy("place").collect()] == [("3", 1000), ("0,1", 540), ("2", 300), ("4", 5)]
    assert [r.inks for r in reduce.merge_palettes(inks, 3).orderBy("place").collect()] == ["3,4", "0,1", "2"]
    close = spark.createDataFrame([(1, 0, 900, 200, 180, 150), (1, 1, 800, 212, 190, 158), (1, 2, 30, 20, 20, 200)], "d long, ink int, n long, r int, g int, b int")
    woven = spark.createDataFrame([(1, 0, 1, 200), (1, 0, 2, 9)], "d long, a int, b int, n long")
    assert [r.inks for r in reduce.merge_palettes(close, 2, woven).orderBy("place").collect()] == ["0,1", "2"]


def test_colour_arrays_agree_with_the_expressions(spark):
    from heddle.functions.layers import add

    rnd = random.Random(1)
    rows = [tuple(rnd.randrange(256) for _ in range(6)) for _ in range(300)] + [(0, 0, 0, 255, 255, 255), (9, 9, 9, 9, 9, 9)]
    df = add(spark.createDataFrame(rows, "r int, g int, b int, u int, v int, w int"), [*colour.lab("p"), *colour.lab("q", "u", "v", "w"), *colour.de2000("p", "q")])
    got = df.collect()
    lab = colour.lab_array(np.array([[r.r, r.g, r.b] for r in got]))
    other = colour.lab_array(np.array([[r.u, r.v, r.w] for r in got]))
    assert np.allclose(lab, [[r.llp, r.aap, r.bbp] for r in got], atol=1e-6)
    assert np.allclose(colour.de2000_array(lab, other), [r.de for r in got], atol=1e-5)
    # published: white, and the sRGB primaries in CIE Lab (D65)
    for rgb, want in (((255, 255, 255), (100, 0, 0)), ((255, 0, 0), (53.24, 80.09, 67.20)), ((0, 255, 0), (87.73, -86.18, 83.18)), ((0, 0, 255), (32.30, 79.19, -107.86))):
        assert np.allclose(colour.lab_array(np.array(rgb)), want, atol=0.05)


def test_hairlines_come_back(spark):
    line = picture(spark, 30, 30, lambda x, y: RED if x == 12 else CREAM)
    flat = line.selectExpr("d", "x", "y", "244 as r", "232 as g", "204 as b")
    got = {(r.x, r.y) for r in reduce.keep_hairlines(line, flat).where("r = 192").collect()}
    assert {(12, y) for y in range(3, 27)} <= got <= {(12, y) for y in range(30)}
    dot = picture(spark, 12, 12, lambda x, y: RED if (x, y) == (5, 5) else CREAM)
    assert reduce.keep_hairlines(dot, flat).where("r = 192").count() == 0


def test_neighbours(spark):
    labels = grid(spark, ["000", "010", "000"])
    assert [(r.ink, r.dots) for r in raster.isolated_dots(labels).collect()] == [(1, 1)]
    assert {(r.x, r.y): r["mode"] for r in raster.mode_filter(labels).collect()}[(1, 1)] == 0
    assert [(r.a, r.b, r.n) for r in raster.contacts(labels).collect()] == [(0, 1, 4)]


def test_swap_plan_takes_the_closest_pairs_first(spark):
    rnd = random.Random(3)
    pairs = [(d, i, f"s{j}", float(rnd.randrange(40))) for d in range(4) for i in range(6) for j in range(5)]
    got = sorted((r.d, r.ink, r.shelf, r.de) for r in screens.swap_plan(spark.createDataFrame(pairs, "d int, ink int, shelf string, de double")).collect())
    want, used = [], set()
    for d, i, s_, de in sorted(pairs, key=lambda p: (p[0], p[3], p[1], p[2])):
        if (d, "ink", i) not in used and (d, "shelf", s_) not in used:
            used |= {(d, "ink", i), (d, "shelf", s_)}
            want.append((d, i, s_, de))
    assert got == sorted(want)


def test_methods_are_scored_alike(spark):
    rows = [(1, (200 << 16) | 10, 50), (1, (20 << 16) | 200, 30), (1, (90 << 16) | (90 << 8) | 90, 5), (1, (205 << 16) | 12, 9)]
    counts = palette.with_lab(spark.createDataFrame(rows, "d long, rgb int, n long"))
    got = {r.method: r.error for r in methods.score_methods(counts, 2).collect()}
    assert set(got) == set(methods.METHODS)
    lab = colour.lab_array(np.array([(c >> 16, c >> 8 & 255, c & 255) for _, c, _ in rows]))
    n = np.array([k for *_, k in rows], float)
    for name, f in methods.METHODS.items():
        order = np.argsort([c for _, c, _ in rows])
        centres = f(lab[order], n[order], 2)
        want = (((lab[:, None] - centres[None]) ** 2).sum(2).min(1) * n).sum() / n.sum()
        assert abs(got[name] - want) < 1e-3
    assert got["k-means"] <= got["commonest"]


def test_results_dont_depend_on_partitions(spark):
    rnd = random.Random(6)
    labels = grid(spark, ["".join(rnd.choice("0012") for _ in range(40)) for _ in range(30)])
    events = spark.createDataFrame([(i, rnd.choice(["made", "stage", "repeat"]), rnd.randrange(9), "auto_ok", rnd.choice(["sent", "approved", None]), i) for i in range(200)], "seq long, event string, job_id long, status string, stage string, t int")
    events = events.selectExpr("*", "timestamp_seconds(t) as time", "'C ' || job_id as client", "'' as design", "1e0 as meters", "2e0 as quote_total", "3e0 as seconds")
    jobs_ = {
        "dots": (labels, raster.isolated_dots), "mode": (labels, raster.mode_filter), "regions": (labels, lambda x: regions.regions(x).drop("region")), "coverage": (labels, palette.coverage), "state": (events, ledger.job_state),
        "hash": (labels.selectExpr("d", "x", "y", "ink * 9 as r", "x as g", "y as b"), screens.design_hash), "specks": (labels, lambda x: regions.clean_specks(x, 1, 1)),
    }
    for name, (table, f) in jobs_.items():
        assert plain(f(table.repartition(7)).collect()) == plain(f(table.coalesce(1)).collect()), name


def test_scores(spark):
    p = picture(spark, 8, 6, lambda x, y: RED if x < 4 else CREAM)
    same = score.pixel_match(p, p).first()
    assert (same.mean_de, same.match) == (0.0, 100.0)
    moved = p.selectExpr("d", "x", "y", "least(255, r + 3) as r", "g", "b - 6 as b", "a")
    got = score.reconstruction(p, moved).first()
    rmse = math.sqrt((9 + 36) / 3)
    assert (got.mae, got.rmse, got.mae_r, got.mae_g, got.mae_b) == (3.0, round(rmse, 4), 3.0, 0.0, 6.0) and abs(got.psnr_db - 20 * math.log10(255 / rmse)) < 1e-3
    assert 0 < score.pixel_match(p, moved).first().match < 100
    labels = p.selectExpr("d", "x", "y", "case when r = 192 then 7 else 3 end as ink")
    truth = p.selectExpr("d", "x", "y", "case when x < 4 or y = 0 then 0 else 1 end as ink")
    pack = lambda c: c[0] << 16 | c[1] << 8 | c[2]
    inks = spark.createDataFrame([(1, 7, pack(RED) + 2), (1, 3, pack(CREAM))], "d long, ink int, rgb int")
    real = spark.createDataFrame([(1, 0, *RED), (1, 1, *CREAM)], "d long, ink int, pr int, pg int, pb int")
    assert score.agreement(labels, inks, truth, real).first().agreement == round(100 * 44 / 48, 4)
    dropped = score.dropped_colours(spark.createDataFrame([(1, pack(RED), 5), (1, pack(RED) + 1, 2)], "d long, rgb int, n long"), real).collect()
    assert [(r.rgb, r.n, r.to_ink) for r in dropped] == [(pack(RED) + 1, 2, 0)]


def test_ground_and_ink_colours(spark):
    p = picture(spark, 12, 12, lambda x, y: RED if 3 <= x < 9 and 3 <= y < 9 else CREAM).selectExpr("*", "case when r = 192 then 1 else 0 end as ink")
    ring = score.ring_shares(p)
    assert [(r.ink, r.ring, r["share"], r.coverage) for r in ring.where("ring > 0").collect()] == [(0, 44, 100.0, 75.0)]
    inks = spark.createDataFrame([(0, *CREAM), (1, *RED)], "ink int, r int, g int, b int")
    assert [tuple(r) for r in score.ground_suggestion(ring, inks, CREAM).collect()] == [(1, 0, True)] and score.ground_suggestion(ring, inks).first().matches is False
    odd = p.withColumn("r", F.when((F.col("x") == 3) & (F.col("ink") == 1), 0).otherwise(F.col("r")))
    assert {r.ink: r.r for r in score.ink_colours(odd).collect()} == {0: 244.0, 1: 192.0}
    line = picture(spark, 3, 1, lambda x, y: (10 * x, 0, 0)).selectExpr("*", "0 as ink", "x = 2 as kept")
    assert score.ink_colours(line, kept="kept").first().r == 20.0 and score.ink_colours(line).first().r == 10.0
    both = spark.createDataFrame([("j", 1, "#aabbcc", None, 10.0), ("j", 2, "#112233", "navy", 5.0), ("j", 3, "#AABBCC", "mist", 2.5)], "owner string, place int, hex string, name string, coverage double")
    assert [tuple(r) for r in score.swap_palette(both).orderBy("place").collect()] == [("j", 1, "#AABBCC", "mist", 12.5, 2), ("j", 2, "#112233", "navy", 5.0, 1)]


def test_image_summary(spark):
    s = score.image_summary(picture(spark, 20, 10, lambda x, y: (255, 255, 255) if x % 2 else (0, 0, 0))).first()
    assert (s.width, s.height, s.colours, s.mean_lum, s.std_lum, s.gradient, s.edges, s.warnings) == (20, 10, 2, 0.5, 0.5, 0.825, 1.0, "small,broad_tones")


def test_proof_and_package(spark):
    labels = grid(spark, ["01", "10"])
    assert screens.verify_package(labels, screens.separate(labels)).first().ok
    assert screens.overlap(screens.separate(labels)).first().exclusive


@pytest.mark.parametrize("plain", [graph.PLAIN, 0])
def test_graph(spark, plain, monkeypatch):
    """With one node of many edges, by plain joins and by broadcasts of busy nodes."""
    monkeypatch.setattr(graph, "PLAIN", plain)
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 200)] + [(500, 501 + k) for k in range(300)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got[20] == 0 and got[200] == 100 and got[800] == 500 and len(got) == 21 + 2 + 301


def test_fixture_covers_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert fixtures.chars(spark, SF).count() == docs.agg(F.sum(F.length("text"))).first()[0]
