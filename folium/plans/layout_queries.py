"""Queries on measures, boxes and strips; integer columns of the driver's tables stand in for pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import geometry
from folium.operators import islands, matching, planning
from folium.plans.text_queries import table

# a page's rows: the lines of a document, ink where a line is not blank, coverage its length's share of 400


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("y", "line"))
    n = F.length("line")
    return lines.select("doc_id", F.col("y").cast("long").alias("y"), F.when(n % 7 < 5, n).otherwise(0).alias("ink"), (n / 400.0).cast("double").alias("coverage"))


PROFILE_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM documents),
profile AS (SELECT doc_id, y, CASE WHEN length(line) % 7 < 5 THEN length(line) ELSE 0 END AS ink, length(line) / 400.0::DOUBLE AS coverage FROM lines)"""


def ink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.ink_runs(profile(spark, sf_dir), ["doc_id"], gap=2, least=2)


INK_SQL = f"""WITH {PROFILE_SQL}, pages AS (SELECT doc_id, max(y) + 1 AS height FROM profile GROUP BY doc_id),
marked AS (SELECT doc_id, y, sum(new) OVER (PARTITION BY doc_id ORDER BY y) AS island FROM (
    SELECT doc_id, y, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y) > 2 THEN 1 ELSE 0 END AS new FROM profile WHERE ink > 0)),
runs AS (SELECT doc_id, min(y) AS start, max(y) + 1 AS stop FROM marked GROUP BY doc_id, island)
SELECT doc_id, start, CASE WHEN height - stop < 2 THEN height ELSE stop END AS stop FROM runs JOIN pages USING (doc_id)
WHERE CASE WHEN height - stop < 2 THEN height ELSE stop END - start >= 2"""


def table_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.table_bands(profile(spark, sf_dir), ["doc_id"], least_rules=2)


BANDS_SQL = f"""WITH {PROFILE_SQL},
pages AS (SELECT doc_id, max(y) + 1 AS height FROM profile GROUP BY doc_id),
dark AS (SELECT doc_id, y, sum(new) OVER (PARTITION BY doc_id ORDER BY y) AS island FROM (
    SELECT doc_id, y, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y) > 3 THEN 1 ELSE 0 END AS new FROM profile WHERE coverage >= 0.55)),
rules AS (SELECT doc_id, min(y) AS top, max(y) AS bottom FROM dark GROUP BY doc_id, island),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY top) AS t FROM (
    SELECT rules.*, height, CASE WHEN top - lag(bottom) OVER (PARTITION BY doc_id ORDER BY top) > greatest(40, floor(height * 0.12)) THEN 1 ELSE 0 END AS new
    FROM rules JOIN pages USING (doc_id)))
SELECT doc_id, greatest(min(top) - floor(height * 0.01)::BIGINT, 0) AS top, least(max(bottom) + floor(height * 0.01)::BIGINT, height) AS bottom, count(*) AS n_rules
FROM grouped GROUP BY doc_id, t, height HAVING count(*) >= 2"""


def _pages(rows: DataFrame) -> DataFrame:
    pages = rows.groupBy("doc_id").agg((F.max("y") + 1).alias("height"))
    return pages.withColumns({"n": F.least(F.greatest(F.floor(F.col("height") / 6), F.lit(1)), F.lit(8)).cast("int"), "pitch": F.lit(1.0)})


def plan_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile(spark, sf_dir)
    return planning.cut_candidates(rows, _pages(rows), None, ["doc_id"]).select("doc_id", F.col("k").cast("long").alias("k"), "y")


CUTS_SQL = f"""WITH {PROFILE_SQL},
pages AS (SELECT doc_id, max(y) + 1 AS height, least(greatest((max(y) + 1) // 6, 1), 8) AS n FROM profile GROUP BY doc_id),
targets AS (SELECT *, floor(k * (height / n::DOUBLE)) AS target, floor(height / n::DOUBLE * 0.4) AS win FROM (SELECT *, unnest(range(1, n)) AS k FROM pages)),
ranked AS (SELECT doc_id, k, y, row_number() OVER (PARTITION BY doc_id, k ORDER BY ink, abs(y - target), y) AS r
    FROM profile JOIN targets USING (doc_id) WHERE y >= greatest(target - win, 1) AND y < least(target + win, height - 1))
SELECT doc_id, k, y FROM ranked WHERE r = 1"""


def plan_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile(spark, sf_dir)
    pages = _pages(rows)
    bands = islands.table_bands(rows, ["doc_id"], least_rules=2)
    return planning.strips(planning.cut_candidates(rows, pages, bands, ["doc_id"]), pages, ["doc_id"]).select("doc_id", F.col("strip").cast("long").alias("strip"), "top", "bottom")


def runs_by_stripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("stripe"), (F.col("l_orderkey") * 40 + F.col("l_partkey") % 17).alias("start"))
    return rows.groupBy("page", "stripe", "start").agg((F.min("start") + 12).alias("stop"))


RUNS = "runs AS (SELECT DISTINCT l_suppkey AS page, l_linenumber AS stripe, l_orderkey * 40 + l_partkey % 17 AS start, l_orderkey * 40 + l_partkey % 17 + 12 AS stop FROM lineitem)"


def median_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = islands.pitch(runs_by_stripe(spark, sf_dir), ["page"])
    pages = islands.needs_strips(found.withColumns({"width": F.lit(10_000), "height": F.lit(40_000)}))
    return pages.select("page", F.round("pitch", 6).alias("pitch"), "dense")


PITCH_SQL = f"""WITH {RUNS}, gaps AS (SELECT page, stripe, (start + stop) / 2.0 - lag((start + stop) / 2.0) OVER w AS gap, count(*) OVER (PARTITION BY page, stripe) AS n
    FROM runs WINDOW w AS (PARTITION BY page, stripe ORDER BY start)),
each AS (SELECT page, stripe, median(gap) AS pitch FROM gaps WHERE n >= 4 GROUP BY page, stripe)
SELECT page, round(median(pitch)::DOUBLE, 6) AS pitch, median(pitch) * 1600 / 40000 < 45 AS dense FROM each GROUP BY page"""


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.line_count(runs_by_stripe(spark, sf_dir), ["page"])


COUNT_SQL = f"WITH {RUNS} SELECT page, floor(median(n))::INT AS lines FROM (SELECT page, stripe, count(*) AS n FROM runs GROUP BY page, stripe) GROUP BY page"


def low_quartile_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").cast("int").alias("h"))
    low = islands.low_quartile(rows, ["page"], "h")
    return low.join(islands.upper_middle(rows, ["page"], "h"), "page").select("page", F.col("height").cast("int").alias("height"), "middle")


QUARTILE_SQL = """SELECT page, CASE WHEN len(v) < 3 THEN 8 ELSE greatest(v[len(v) // 4 + 1], 8) END::INT AS height, v[len(v) // 2 + 1] AS middle
FROM (SELECT l_orderkey AS page, list_sort(list(l_quantity::INT)) AS v FROM lineitem GROUP BY l_orderkey)"""

# --- boxes ---------------------------------------------------------------------------------------

BOX = {
    "x0": "l_partkey * 7 % 1100 - 50", "y0": "l_suppkey * 13 % 900",
    "x1": "l_partkey * 7 % 1100 - 50 + cast(l_quantity as int) * 9 - 60", "y1": "l_suppkey * 13 % 900 + l_linenumber * 30",
}
ITEMS = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"
BOX_SQL = "boxes AS (SELECT page, k, least(cx0, cx1) AS x0, least(cy0, cy1) AS y0, greatest(cx0, cx1) AS x1, greatest(cy0, cy1) AS y1 FROM (SELECT l_orderkey AS page, l_linenumber AS k, " + ", ".join(f"greatest(0, least(1000, {e})) AS c{n}" for n, e in BOX.items()) + f" FROM {ITEMS}))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and line: the driver's pairs repeat."""
    least = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*least)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = geometry.box(*[F.expr(e) for e in BOX.values()])
    return items(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), geometry.clamped(raw).alias("box"))


def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    other = rows.select("page", (F.col("k") - 1).alias("k"), F.col("box").alias("next"))
    found = rows.join(other, ["page", "k"])
    return found.select("page", "k", F.round(geometry.iou(F.col("box"), F.col("next")), 9).alias("iou"), geometry.usable(F.col("box")).alias("usable"))


IOU_SQL = f"""WITH {BOX_SQL}, pairs AS (SELECT a.page, a.k, a.x1 - a.x0 >= 15 AND a.y1 - a.y0 >= 15 AS usable,
    greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS shared,
    (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas FROM boxes a JOIN boxes b ON a.page = b.page AND b.k = a.k + 1)
SELECT page, k, round(CASE WHEN areas - shared > 0 THEN shared / (areas - shared)::DOUBLE ELSE 0 END, 9) AS iou, usable FROM pairs"""


def reading_order_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    found = matching.matched_boxes(rows, rows.select("page", "k", "box"), ["page"], nth="k")
    return found.select("page", "k", "box.x0", "box.y0", "box.x1", "box.y1")


ORDER_SQL = f"""WITH {BOX_SQL}, inline AS (SELECT page, k, row_number() OVER (PARTITION BY page ORDER BY k) AS i FROM boxes),
located AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, x0 + x1) AS i FROM boxes)
SELECT inline.page, inline.k, x0, y0, x1, y1 FROM inline JOIN located USING (page, i)"""


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    found = matching.matched_boxes(rows, rows.where("k > 1").select("page", "k", "box"), ["page"], nth="k")
    return found.select("page", "k", "box.*", "located")


GREEDY_SQL = f"""WITH RECURSIVE {BOX_SQL},
inline AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) AS i, count(*) OVER (PARTITION BY page) AS n FROM boxes),
located AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, x0 + x1) AS j, count(*) OVER (PARTITION BY page) AS n FROM boxes WHERE k > 1),
pairs AS (SELECT a.page, list_sort(list({{'gap': abs((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0), 'i': a.i, 'j': b.j}})) AS rest
    FROM inline a JOIN located b ON a.page = b.page AND a.n <> b.n AND abs((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0) <= 150 GROUP BY a.page),
taken AS (SELECT page, rest[1] AS p, list_filter(rest[2:], lambda x: x.i <> rest[1].i AND x.j <> rest[1].j) AS rest FROM pairs
    UNION ALL SELECT page, rest[1], list_filter(rest[2:], lambda x: x.i <> rest[1].i AND x.j <> rest[1].j) FROM taken WHERE len(rest) > 0),
links AS (SELECT page, p.i AS i, p.j AS j FROM taken UNION ALL SELECT a.page, a.i, b.j FROM inline a JOIN located b ON a.page = b.page AND a.n = b.n AND a.i = b.j)
SELECT a.page, a.k, coalesce(b.x0, a.x0) AS x0, coalesce(b.y0, a.y0) AS y0, coalesce(b.x1, a.x1) AS x1, coalesce(b.y1, a.y1) AS y1, b.page IS NOT NULL AS located
FROM inline a LEFT JOIN links USING (page, i) LEFT JOIN located b ON a.page = b.page AND links.j = b.j"""


def remap_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = lambda v: geometry.strip_to_page(F.col(f"box.{v}"), F.col("k") * 100, F.lit(250), F.lit(1700)).alias(v)
    back = geometry.unpadded(F.col("box.x0"), F.lit(40), F.lit(0.8), F.lit(3600)).alias("x0")
    return boxes(spark, sf_dir).select("page", "k", y("y0"), y("y1"), back)


REMAP_SQL = f"""WITH {BOX_SQL} SELECT page, k, round_even((k * 100 + y0 / 1000.0::DOUBLE * 250) / 1700 * 1000, 0)::INT AS y0,
round_even((k * 100 + y1 / 1000.0::DOUBLE * 250) / 1700 * 1000, 0)::INT AS y1,
least(greatest(round_even((x0 / 1000.0::DOUBLE * (3600 * 0.8::DOUBLE + 80) - 40) / (3600 * 0.8::DOUBLE) * 1000, 0), 0), 1000)::INT AS x0 FROM boxes"""


def seam_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("page", F.col("k").alias("strip"), F.lit(1).alias("i"), "box", (F.col("box.y1") + F.col("k") % 3 * 12).alias("cut"))
    found = planning.seam_merges(rows, ["page"])
    return found.select("page", "strip", "box.*", "merged")


SEAM_SQL = f"""WITH RECURSIVE {BOX_SQL}, figs AS (SELECT *, y1 + k % 3 * 12 AS cut, row_number() OVER w AS nth, lead(k) OVER w AS nk, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0,
    lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1 FROM boxes WINDOW w AS (PARTITION BY page ORDER BY k)),
judged AS (SELECT *, coalesce(nk = k + 1 AND abs(y1 - cut) <= 20 AND abs(ny0 - cut) <= 20
    AND least(x1, nx1) - greatest(x0, nx0) >= 0.5 * greatest(least(x1 - x0, nx1 - nx0), 1), false) AS joins FROM figs),
steps AS (SELECT page, nth, joins AS merged, false AS gone FROM judged WHERE nth = 1
    UNION ALL SELECT j.page, j.nth, j.joins AND NOT s.merged, s.merged FROM steps s JOIN judged j ON j.page = s.page AND j.nth = s.nth + 1)
SELECT page, k AS strip, CASE WHEN merged THEN least(x0, nx0) ELSE x0 END AS x0, y0, CASE WHEN merged THEN greatest(x1, nx1) ELSE x1 END AS x1,
       CASE WHEN merged THEN ny1 ELSE y1 END AS y1, merged FROM judged JOIN steps USING (page, nth) WHERE NOT gone"""


def figure_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("page", "k", geometry.figure_command((F.col("page") % 1000).cast("int"), F.col("k"), F.col("box")).alias("command"))


FIGURE_SQL = f"""WITH {BOX_SQL} SELECT page, k, CASE WHEN x1 - x0 >= 15 AND y1 - y0 >= 15
    THEN '\\begin{{center}}\\includegraphics[width=' || printf('%.2f', round(least(greatest((x1 - x0) / 1000.0::DOUBLE / 0.86::DOUBLE * 0.82::DOUBLE, 0.2::DOUBLE), 0.78::DOUBLE) + 1e-9, 2)) || '\\linewidth]{{p' || lpad((page % 1000)::VARCHAR, 4, '0') || '_f' || k || '.png}}\\end{{center}}'
    ELSE '\\textit{{[figure omitted]}}' END AS command FROM boxes"""


def parse_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.format_string('Found: ```json\n[{"bbox": [%d, 10.5, %d, 900]}, [1, 2, 3], [5, 6, 1200, %d], {"bbox_2d": [1,2,30,40]}, "x"]```', "l_linenumber", "l_partkey", F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(geometry.parsed_boxes(reply)).alias("i", "b"))
    return rows.groupBy("i").agg(F.count("*").alias("n"), F.sum("b.x0").alias("x0"), F.sum("b.y0").alias("y0"), F.sum("b.x1").alias("x1"), F.sum("b.y1").alias("y1"))


PARSE_SQL = """WITH b AS (SELECT 0 AS i, least(l_linenumber, least(l_partkey, 1000)) AS x0, 10 AS y0, greatest(l_linenumber, least(l_partkey, 1000)) AS x1, 900 AS y1 FROM lineitem
UNION ALL SELECT 1, 5, least(6, l_suppkey), 1000, greatest(6, least(l_suppkey, 1000)) FROM lineitem UNION ALL SELECT 2, 1, 2, 30, 40 FROM lineitem)
SELECT i, count(*) AS n, sum(x0)::BIGINT AS x0, sum(y0)::BIGINT AS y0, sum(x1)::BIGINT AS x1, sum(y1)::BIGINT AS y1 FROM b GROUP BY i"""

# --- cells ---------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("page"), (F.col("l_partkey") * 31 % 997).alias("x"), (F.col("l_orderkey") * 17 % 991).alias("y"))


def hot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.hot_cells(points(spark, sf_dir), ["page"], "x", "y")


CELLS = """points AS (SELECT l_suppkey % 5 AS page, l_partkey * 31 % 997 AS x, l_orderkey * 17 % 991 AS y FROM lineitem),
cells AS (SELECT page, y // 50 AS cy, x // 50 AS cx, count(*) AS n FROM points GROUP BY ALL),
hot AS (SELECT page, cy, cx, n FROM (SELECT *, sum(n) OVER (PARTITION BY page) AS total FROM cells) WHERE n >= greatest(20, floor(total / 500)))"""
HOT_SQL = f"WITH {CELLS} SELECT * FROM hot"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = matching.hot_cells(points(spark, sf_dir), ["page"], "x", "y", least=26)
    found = matching.cell_components(cells, ["page"])
    return found.groupBy("page", "component").agg(F.count("*").alias("cells"), F.sum("n").alias("mass"), F.min("cy").alias("cy"), F.min("cx").alias("cx")).drop("component")


COMPONENTS_SQL = (
    "WITH RECURSIVE "
    + CELLS.replace("greatest(20,", "greatest(26,")
    + """,
reach AS (SELECT page, cy, cx, cy AS ry, cx AS rx FROM hot
    UNION SELECT h.page, h.cy, h.cx, r.ry, r.rx FROM reach r JOIN hot h ON h.page = r.page AND abs(h.cy - r.cy) <= 1 AND abs(h.cx - r.cx) <= 1),
labelled AS (SELECT page, cy, cx, min((ry, rx)) AS root FROM reach GROUP BY page, cy, cx)
SELECT page, count(*) AS cells, sum(n)::BIGINT AS mass, min(cy) AS cy, min(cx) AS cx FROM labelled JOIN hot USING (page, cy, cx) GROUP BY page, root"""
)


def best_strip_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("strip"), F.col("l_linenumber").alias("variant"), (F.col("l_quantity") > 40).alias("ok"), (F.col("l_quantity") % 10).alias("score"))
    return planning.best_reads(rows, ["strip"])


BEST_SQL = f"""WITH reads AS (SELECT l_orderkey AS strip, l_linenumber AS variant, l_quantity > 40 AS ok, l_quantity % 10 AS score FROM {ITEMS}),
tried AS (SELECT *, coalesce(bool_or(ok) OVER (PARTITION BY strip ORDER BY variant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM reads),
ranked AS (SELECT *, row_number() OVER (PARTITION BY strip ORDER BY score DESC, variant) AS r FROM tried WHERE NOT done AND score > 0)
SELECT strip, variant, ok, score FROM ranked WHERE r = 1"""

def region_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.region_routes(boxes(spark, sf_dir), F.lit(1000), F.lit(800)).select("page", "k", "colors_text", "in_corner")


ROUTES_SQL = f"WITH {BOX_SQL} SELECT page, k, (x0 + x1) / 2000.0 >= 0.15 AS colors_text, (x0 + x1) / 2000.0 > 0.6 AND (y0 + y1) / 1600.0 < 0.25 AS in_corner FROM boxes"


def margin_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.expr("CASE k % 3 WHEN 0 THEN array('red') WHEN 1 THEN array('blue') ELSE array('red', 'green') END")
    return matching.margin_colors(boxes(spark, sf_dir).withColumn("names", names), ["page"], F.lit(1000))


MARGIN_COLORS_SQL = f"""WITH {BOX_SQL}, named AS (
    SELECT page, unnest(CASE k % 3 WHEN 0 THEN ['red'] WHEN 1 THEN ['blue'] ELSE ['red', 'green'] END) AS name FROM boxes WHERE (x0 + x1) / 2000.0 < 0.15)
SELECT page, CASE WHEN min(name) = max(name) THEN min(name) END AS color FROM (SELECT DISTINCT page FROM boxes) LEFT JOIN named USING (page) GROUP BY page"""


def protected_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("page", "k", "box.y0", F.least(F.col("box.y1") + F.col("k") * 60, F.lit(1000)).alias("y1"))
    tables = rows.where("k = 1").select("page", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    pages = rows.select("page").distinct().withColumns({"height": F.lit(1000), "pitch": F.expr("nullif(page % 50, 0)")})
    found = planning.protected_bands(tables, rows.where("k > 1"), pages, ["page"])
    return found.select("page", F.col("top").cast("long").alias("top"), F.col("bottom").cast("long").alias("bottom"))


PROTECTED_SQL = f"""WITH {BOX_SQL}, tall AS (SELECT page, k, y0, least(y1 + k * 60, 1000) AS y1 FROM boxes), padded AS (
    SELECT page, y0 AS top, y1 AS bottom FROM tall WHERE k = 1
    UNION ALL SELECT page, greatest(0, y0 - pad), least(1000, y1 + pad) FROM (SELECT *, CASE page % 50 WHEN 0 THEN 5 ELSE page % 50 // 2 END AS pad FROM tall WHERE k > 1))
SELECT page, top::BIGINT AS top, bottom::BIGINT AS bottom FROM padded WHERE bottom - top <= 400"""

QUERIES = {
    "region_routes": region_routes, "margin_colors": margin_colors, "protected_bands": protected_bands,
    "ink_runs": ink_runs, "table_bands": table_bands, "plan_cuts": plan_cuts, "plan_strips": plan_strips, "median_pitch": median_pitch,
    "line_counts": line_counts, "low_quartile_height": low_quartile_height, "box_iou": box_iou, "reading_order_match": reading_order_match,
    "greedy_match": greedy_match, "remap_boxes": remap_boxes, "seam_merge": seam_merge, "figure_commands": figure_commands,
    "parse_boxes": parse_boxes, "hot_cells": hot_cells, "components": components, "best_strip_reads": best_strip_reads,
}
ORACLES = {
    "region_routes": ROUTES_SQL, "margin_colors": MARGIN_COLORS_SQL, "protected_bands": PROTECTED_SQL,
    "ink_runs": INK_SQL, "table_bands": BANDS_SQL, "plan_cuts": CUTS_SQL, "median_pitch": PITCH_SQL, "line_counts": COUNT_SQL,
    "low_quartile_height": QUARTILE_SQL, "box_iou": IOU_SQL, "reading_order_match": ORDER_SQL, "greedy_match": GREEDY_SQL, "remap_boxes": REMAP_SQL,
    "seam_merge": SEAM_SQL, "figure_commands": FIGURE_SQL, "parse_boxes": PARSE_SQL, "hot_cells": HOT_SQL,
    "components": COMPONENTS_SQL, "best_strip_reads": BEST_SQL,
}
