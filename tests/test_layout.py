import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.functions import geometry, images
from folium.operators import islands, matching, planning
from folium.plans import layout_queries


def png(a):
    h, w = a.shape[:2]
    rows = b"".join(b"\0" + a[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def blank(h, w):
    return np.full((h, w, 3), 255)


def lined(h=1000, w=800, pitch=50, tall=20):
    a = blank(h, w)
    for y in range(40, h - 40, pitch):
        a[y : y + tall, 40 : w - 40] = 0
    return a


def test_measures():
    mask = images.ink(lined())
    assert images.line_pitch(mask) == 50 and images.line_count(mask, 50) == len(range(40, 960, 50)) and images.line_height(mask) == 20
    assert images.line_pitch(images.ink(blank(200, 200))) is None and images.line_count(images.ink(blank(200, 200)), None) == 0


def test_colors():
    a = blank(400, 400)
    a[50:120, 300:380] = (255, 78, 225)
    a[200:240, 20:60] = (20, 160, 30)
    a[300:350, 50:350] = 0
    assert images.page_colors(a) == ["pink", "green"] and images.page_colors(lined()) == []
    kept = images.color_only(a)
    assert (kept[60, 310] == (255, 78, 225)).all() and (kept[320, 100] == 255).all()


def test_segments():
    a = blank(240, 620)
    for top in (20, 90, 160):
        for x in range(30, 330, 22):
            a[top : top + 12, x : x + 10] = 0
    a[90:180, 400:410] = 0
    kinds = [r["kind"] for r in images.text_lines(a)]
    assert kinds.count("math") == 1 and "text" in kinds
    assert images.text_lines(blank(100, 100)) == []


def test_snapping():
    a = blank(2000, 1000)
    a[600:900, 300:700] = 0
    mask = images.ink(a)
    assert images.snapped(mask, (310, 610, 690, 890), 60) == (292, 592, 708, 908)
    assert images.snapped(mask, (10, 10, 200, 200), 60) is None
    prose = images.ink(lined(1000, 800, 50, 30))
    assert images.snapped(prose, (40, 130, 760, 330), 30) is None
    framed = images.variant(lined(), 40, 0.5)
    assert framed.shape == (580, 480, 3) and (framed[0] == 255).all()


def test_images_on_spark(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(lined()))
    rows = spark.read.format("image").load(f"file://{tmp_path}")
    got = rows.select(images.image_pitch("image").alias("pitch"), images.image_colors("image").alias("colors"), images.image_line_height("image").alias("h"), F.size(images.image_lines("image")).alias("n")).first()
    assert (got.pitch, got.colors, got.h, got.n) == (50.0, [], 20, 19)


def profile(spark, values):
    return spark.createDataFrame([(1, y, float(v)) for y, v in enumerate(values)], "page int, y long, ink double")


def test_runs(spark):
    rows = profile(spark, [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1])
    got = sorted(tuple(r)[1:] for r in islands.ink_runs(rows, ["page"], 2, 2).collect())
    assert got == [(0, 5), (11, 16)]
    assert sorted(tuple(r)[1:] for r in islands.merged_bands(rows, ["page"], 3).collect()) == [(0, 8), (11, 16)]
    assert sorted(tuple(r)[1:] for r in islands.row_bands(rows, ["page"], 3).collect()) == [(0, 8), (11, 15)]
    assert images.runs(np.array([1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1], bool), 2) == [(0, 5), (7, 8), (11, 16)]


def test_runs_reach_the_end_of_the_page(spark):
    rows = profile(spark, [1, 1, 1, 1, 0])
    assert [tuple(r)[1:] for r in islands.ink_runs(rows, ["page"]).collect()] == [(0, 5)]
    rows = profile(spark, [0, 1, 1, 1, 1, 0, 0])
    assert [tuple(r)[1:] for r in islands.ink_runs(rows, ["page"]).collect()] == [(1, 5)]
    mask = np.zeros((20, 100), dtype=bool)
    mask[3:9], mask[14:19] = True, True
    assert images.stripe_runs(mask)[0] == [(3, 9), (14, 20)]


def test_seam_chains_go_in_order(spark):
    schema = "page int, strip int, i int, box struct<x0:int,y0:int,x1:int,y1:int>, cut int"
    chain = [(1, k, 1, (10, 100 * k, 90, 100 * k + 100), 100 * k + 100) for k in range(3)]
    two = [(2, 0, 1, (10, 0, 90, 100), 100), (2, 1, 1, (10, 100, 90, 140), 200), (2, 1, 2, (10, 150, 90, 200), 200), (2, 2, 1, (10, 200, 90, 300), 300)]
    got = planning.seam_merges(spark.createDataFrame(chain + two, schema), ["page"]).collect()
    rows = sorted((r.page, r.strip, r.i, r.box.y0, r.box.y1, r.merged) for r in got)
    # three strips: the first two are one, the third stays; a strip of two markers takes part on both sides
    assert rows == [(1, 0, 1, 0, 200, True), (1, 2, 1, 200, 300, False), (2, 0, 1, 0, 140, True), (2, 1, 2, 150, 300, True)]


def test_tables(spark):
    values = np.zeros(1400)
    for y in (200, 260, 320, 380, 440):
        values[y : y + 4] = 0.9
    values[1200:1204] = 0.9
    bands = islands.table_bands(profile(spark, values.tolist()).withColumnRenamed("ink", "coverage"), ["page"])
    assert [tuple(r) for r in islands.biggest_table(bands, ["page"]).collect()] == [(1, 186, 457, 5)]


def test_cuts(spark):
    values = [0.0 if y % 10 == 0 else 5.0 for y in range(100)]
    pages = spark.createDataFrame([(1, 100, 3, 2.0)], "page int, height long, n int, pitch double")
    bands = spark.createDataFrame([(1, 28, 35)], "page int, top long, bottom long")
    cuts = planning.cut_candidates(profile(spark, values), pages, bands, ["page"])
    got = sorted(tuple(r)[1:] for r in planning.strips(cuts, pages, ["page"]).collect())
    assert got == [(1, 0, 40), (2, 40, 70), (3, 70, 100)]


def test_cuts_through_a_tall_band(spark, tmp_path):
    values = [0.0 if y % 10 == 0 else 5.0 for y in range(100)]
    pages = spark.createDataFrame([(p, 100, 3, 2.0) for p in (1, 2)], "page int, height long, n int, pitch double")
    bands = spark.createDataFrame([(1, 20, 60), (2, 20, 61)], "page int, top long, bottom long")
    both = profile(spark, values).union(profile(spark, values).withColumn("page", F.lit(2)))
    cuts = planning.cut_candidates(both, pages, bands, ["page"]).orderBy("page", "k").select("page", "k", "y").collect()
    # 40 rows still protect: the first cut of page 1 has none of the rows near 33 but those above 20
    assert [tuple(c) for c in cuts] == [(1, 2, 70), (2, 1, 30), (2, 2, 70)]
    line = "x" * 301
    text = "\n".join([line if y in (1, 16) else "" for y in range(18)])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert layout_queries.plan_strips(spark, str(tmp_path)).count() == 3


def test_streaks(spark):
    kinds = ["bad", "bad", "skip", "bad", "good", "bad", "skip"]
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "job int, page int, kind string")
    found = islands.failure_streaks(rows, ["job"], "page", F.col("kind") == "bad", F.col("kind") == "good")
    assert [r.streak for r in found.orderBy("page").collect()] == [1, 2, 2, 3, 0, 1, 1]
    trips = islands.breaker_trips(found, ["job"], "page")
    assert [r.skipped for r in islands.after_trip(rows, trips, ["job"], "page").orderBy("page").collect()] == [False] * 4 + [True] * 3


def test_boxes(spark):
    replies = ['[{"bbox": [1, 2.5, 30, 2000]}, [9, 8, 7, 6], [1, 2]]', "none", None, '```json\n[{"bbox_2d": [1,2,3,4]}]\n```']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", geometry.parsed_boxes(F.col("r")).alias("b"))
    got = {r.i: [tuple(b) for b in r.b or []] for r in rows.collect()}
    assert got == {0: [(1, 2, 30, 1000), (7, 6, 9, 8)], 1: [], 2: [], 3: [(1, 2, 3, 4)]}


def test_matching(spark):
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    inline = spark.createDataFrame([(1, 0, (0, 100, 50, 200)), (1, 1, (0, 500, 50, 600)), (1, 2, (0, 900, 50, 990))], f"page int, k int, box {box}")
    located = spark.createDataFrame([(1, (5, 520, 60, 640)), (1, (5, 90, 60, 180))], f"page int, box {box}")
    got = {r.k: (tuple(r.box), r.located) for r in matching.matched_boxes(inline, located, ["page"]).collect()}
    assert got == {0: ((5, 90, 60, 180), True), 1: ((5, 520, 60, 640), True), 2: ((0, 900, 50, 990), False)}
    cells = spark.createDataFrame([(1, y, x, 30) for y, x in [(0, 0), (1, 1), (5, 5), (5, 6), (9, 0)]], "page int, cy long, cx long, n long")
    found = matching.cell_components(cells, ["page"]).collect()
    assert len({r.component for r in found}) == 3


def test_boxes_with_one_centre_keep_the_locators_order(spark):
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    inline = spark.createDataFrame([(1, k, (0, 0, 9, 9)) for k in range(2)], f"page int, k int, box {box}")
    located = spark.createDataFrame([(1, 0, (20, 30, 40, 50)), (1, 1, (10, 20, 50, 60))], f"page int, n int, box {box}")
    got = {r.k: tuple(r.box) for r in matching.matched_boxes(inline, located, ["page"], nth="n").collect()}
    assert got == {0: (20, 30, 40, 50), 1: (10, 20, 50, 60)}
    three = inline.unionByName(spark.createDataFrame([(1, 2, (0, 400, 9, 409))], inline.schema))
    got = {r.k: tuple(r.box) for r in matching.matched_boxes(three, located, ["page"], nth="n").collect()}
    assert got == {0: (20, 30, 40, 50), 1: (10, 20, 50, 60), 2: (0, 400, 9, 409)}


@pytest.mark.parametrize("k", range(2))
def test_tables_in_text(spark, k):
    page = "Title\n\nbody\n\n\\begin{tabular}{l} a \\\\ b \\\\ \\end{tabular}"
    read = ["\\begin{tabular}{l} A \\\\ B \\\\ C \\end{tabular}", "\\begin{tabular}{l} A \\end{tabular}"][k]
    row = spark.createDataFrame([(page, read)], "p string, r string")
    got = row.select(
        matching.table_swapped(F.col("p"), F.col("r")).alias("s"),
        matching.table_inserted(F.lit("Title\n\nbody"), F.col("r"), F.lit(0), F.lit(10), F.lit(900)).alias("i"),
        matching.table_to_corner(F.col("p"), F.array(F.lit("b"))).alias("c"),
    ).first()
    assert ("A" in got.s) == (k == 0)
    assert got.i == "Title\n\n\\fitpage{" + read + "}\n\nbody"
    assert got.c.startswith("Title\n\n\\begin{wraptable}{r}{0.6\\textwidth}\n\\begin{tabular}") and got.c.endswith("\n\nbody")
