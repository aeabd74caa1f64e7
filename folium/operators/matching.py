"""Matches between readings: boxes, colours, tables, errors and hints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import geometry
from folium.functions.repair import is_similar
from folium.functions.text import let


def matched_boxes(inline: DataFrame, located: DataFrame, keys: list[str], most: int = 150, nth: str | None = None) -> DataFrame:
    """``inline`` (k, box) with the box that the locator found for it, else its own.

    Where both have as many, the k-th in reading order is the k-th; otherwise pairs whose vertical
    centres are at most ``most`` apart are taken greedily, the closest first. Boxes of ``located`` with
    one centre stay in the order of its column ``nth``, the locator's; without it their corners decide.
    Each side is one array a page, so a page's boxes meet in one join and the matching is a fold over their pairs.
    """
    own = inline.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "box"))).alias("own"))
    place = [geometry.reading_key(F.col("box")).alias("at"), *([F.col(nth).alias("nth")] if nth else []), "box"]
    found = located.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*place))).alias("found"))
    centre = lambda b: (b["y0"] + b["y1"]) / 2

    def pairs() -> Column:
        pair = lambda o, i, f, j: F.struct(F.abs(centre(o["box"]) - centre(f["box"])).alias("gap"), i.alias("i"), j.alias("j"))
        every = F.flatten(F.transform("own", lambda o, i: F.transform("found", lambda f, j: pair(o, i, f, j))))
        return F.sort_array(F.filter(every, lambda p: p["gap"] <= most))

    def step(taken: Column, p: Column) -> Column:
        used = F.exists(taken, lambda t: (t["i"] == p["i"]) | (t["j"] == p["j"]))
        return F.when(used, taken).otherwise(F.array_append(taken, p))

    def placed(links: Column) -> Column:
        link = lambda i: F.get(F.filter(links, lambda t: t["i"] == i), 0)["j"]
        other = lambda i: F.get("found", F.when(F.size("own") == F.size("found"), i).otherwise(link(i)))["box"]
        row = lambda o, i: F.struct(o["k"].alias("k"), F.coalesce(other(i), o["box"]).alias("box"), other(i).isNotNull().alias("located"))
        return F.transform("own", row)

    links = F.when(F.size("own") != F.size("found"), F.aggregate(pairs(), F.array().cast("array<struct<gap:double,i:int,j:int>>"), step))
    both = own.join(found, keys, "left").select(*keys, F.explode(let(links, placed)).alias("m"))
    return both.select(*keys, "m.k", "m.box", "m.located")


def refuted_runs(runs: DataFrame, reads: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """``runs`` (run, color, plain) with ``refuted``: their colour was read and no read is like them.

    ``reads`` has (color, plain), a null text for a colour that was read without any; ``exact``
    asks for equal texts instead of similar ones.
    """
    read = reads.select(*keys, "color").distinct().withColumn("_read", F.lit(True))
    texts = reads.where("plain is not null").select(*keys, "color", F.col("plain").alias("_other"))
    alike = F.col("plain") == F.col("_other") if exact else is_similar(F.col("plain"), F.col("_other"))
    like = runs.join(texts, [*keys, "color"]).where(alike).select(*keys, "run").distinct().withColumn("_like", F.lit(True))
    out = runs.join(read, [*keys, "color"], "left").join(like, [*keys, "run"], "left")
    return out.withColumn("refuted", F.col("_read").isNotNull() & F.col("_like").isNull()).drop("_read", "_like")


# Colour names and the ink family that each belongs to.
FAMILIES = {
    "pink": "pink", "magenta": "pink", "violet": "violet", "purple": "violet", "orange": "orange", "brown": "orange",
    "yellow": "yellow", "green": "green", "lime": "green", "olive": "green", "teal": "cyan", "cyan": "cyan", "blue": "blue",
    "red": "red",
}


def absent_runs(runs: DataFrame, present: Column) -> DataFrame:
    """``runs`` (color) with ``absent``: their family is known and not among the page's ink, array ``present``."""
    family = F.try_element_at(F.create_map(*[F.lit(x) for p in FAMILIES.items() for x in p]), F.lower("color"))
    return runs.withColumn("absent", F.coalesce(~F.array_contains(present, family), F.lit(False)))


# The margin's share of a page's width, and where its top right corner begins.
MARGIN, CORNER_X, CORNER_Y = 0.15, 0.6, 0.25


def region_routes(regions: DataFrame, width: Column, height: Column) -> DataFrame:
    """F16: ``regions`` (box) with ``colors_text``, outside the margin, and ``in_corner``, where a corner table stands."""
    box = F.col("box")
    cx, cy = (box["x0"] + box["x1"]) / 2 / width, (box["y0"] + box["y1"]) / 2 / height
    return regions.withColumns({"colors_text": cx >= MARGIN, "in_corner": (cx > CORNER_X) & (cy < CORNER_Y)})


def margin_colors(regions: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """The one colour of each page's margin; null where regions there (box, names) have none or several."""
    centre = (F.col("box")["x0"] + F.col("box")["x1"]) / 2 / F.greatest(width, F.lit(1))
    named = regions.select(*keys, F.explode_outer(F.when(centre < MARGIN, F.col("names"))).alias("name"))
    found = named.groupBy(*keys).agg(F.collect_set("name").alias("names"))
    return found.select(*keys, F.when(F.size("names") == 1, F.get("names", F.lit(0))).alias("color"))


# What a compiler's message says, in the order in which hints are given.
HINT_RULES = (
    ("alignment", r"Misplaced alignment tab|Extra alignment tab"),
    ("math mode", r"allowed only in math mode|Missing \$ inserted"),
    ("unicode", r"Unicode character"),
    ("color paragraph", r"Paragraph ended before \\@?textcolor"),
    ("hash", r"macro parameter character #"),
    ("environment", r"Environment [\w*-]+ undefined"),
    ("figure", r"No shape named|tikz@f@|Package tikz Error|Giving up on this path"),
    ("preamble", r"Can be used only in preamble"),
    ("macro", r"Undefined control sequence"),
)


def error_hints(errors: Column) -> Column:
    """Names of the rules that the errors' text meets, in rule order."""
    text = F.array_join(errors, "\n")
    return F.filter(F.array(*[F.when(text.rlike(p), name) for name, p in HINT_RULES]), lambda x: x.isNotNull())


TABULAR = r"(?s)(\\begin\{tabular\}.*?\\end\{tabular\})"


def _rows(text: Column) -> Column:
    """A12"""
    return F.regexp_count(text, F.lit(r"\\\\"))


def table_swapped(page: Column, read: Column) -> Column:
    """The page with its only table as it was re-read, unless that lost more than a row."""
    old, new = F.regexp_extract(page, TABULAR, 1), F.regexp_extract(read, TABULAR, 1)
    once = F.regexp_count(page, F.lit(r"\\begin\{tabular\}")) == 1
    return F.when(once & (old != "") & (new != "") & (_rows(new) >= _rows(old) - 1), F.replace(page, old, new)).otherwise(page)


def table_inserted(page: Column, read: Column, top: Column, bottom: Column, height: Column) -> Column:
    """The page with a table it lacks: after its first block if the band is in the top third, else at its end."""
    new = F.regexp_extract(read, TABULAR, 1)
    table = F.concat(F.lit(r"\fitpage{"), new, F.lit("}"))
    blocks = F.filter(F.split(F.regexp_replace(page, r"\A\s+|\s+\z", ""), r"\n\s*\n", -1), lambda b: F.regexp_like(b, F.lit(r"\S")))
    high = (top + bottom) / 2 / F.greatest(height, F.lit(1)) < 1 / 3
    placed = F.when(F.size(blocks) == 0, F.array(table)).when(high, F.array_insert(blocks, 2, table)).otherwise(F.array_append(blocks, table))
    return F.when(new == "", page).otherwise(F.array_join(placed, "\n\n"))


def corner_table(page: Column, texts: Column) -> Column:
    """The first table that holds one of ``texts``, or null."""
    return F.get(F.filter(F.regexp_extract_all(page, F.lit(TABULAR), F.lit(1)), lambda t: F.exists(texts, lambda x: (x != "") & F.contains(t, x))), 0)


def table_to_corner(page: Column, texts: Column) -> Column:
    """That table as a floating one after the page's first block; a page that has one stays."""
    table = corner_table(page, texts)
    rest = F.split(F.regexp_replace(F.replace(F.replace(page, F.concat(F.lit(r"\fitpage{"), table, F.lit("}")), F.lit("")), table, F.lit("")), r"\A\s+|\s+\z", ""), r"\n\s*\n", 2)
    float_ = F.concat(F.lit("\\begin{wraptable}{r}{0.6\\textwidth}\n"), table, F.lit("\n\\end{wraptable}"))
    parts = F.filter(F.array(F.get(rest, 0), float_, F.get(rest, 1)), lambda x: x.isNotNull() & F.regexp_like(x, F.lit(r"\S")))
    return F.when(table.isNull() | page.contains("wraptable"), page).otherwise(F.array_join(parts, "\n\n"))


def with_prefetched(pages: DataFrame, prefetched: DataFrame, keys: list[str]) -> DataFrame:
    """``pages`` with their prefetched reading; ``live`` says that one has to be asked for."""
    return pages.join(prefetched, keys, "left").withColumn("live", F.col("latex").isNull())


def nearest_occurrence(occurrences: DataFrame, keys: list[str], anchor: str = "anchor") -> DataFrame:
    """The occurrence (start, stop) whose middle is nearest to ``anchor``, the first of equally near ones."""
    away = F.abs((F.col("start") + F.col("stop")) / 2 - F.col(anchor))
    best = F.min(F.struct(away.alias("away"), "start", "stop")).alias("best")
    return occurrences.groupBy(*keys).agg(best).select(*keys, "best.start", "best.stop")


def hot_cells(points: DataFrame, keys: list[str], x: str, y: str, side: int = 50, least: int = 20, share: int = 500) -> DataFrame:
    """Cells (cy, cx) of ``side`` units with enough points: ``least``, or one in ``share`` of the page's."""
    cells = points.groupBy(*keys, F.floor(F.col(y) / side).alias("cy"), F.floor(F.col(x) / side).alias("cx")).agg(F.count("*").alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    return cells.join(total, keys).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("total") / share))).drop("total")


def cell_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with ``component``, the first cell of those that touch, sides and corners alike."""
    return cells.groupBy(*keys).applyInPandas(label_page, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema), "component long"]))


def label_page(page: pd.DataFrame) -> pd.DataFrame:
    """A grid is bounded by the page, so one page's cells are few."""
    order = page.sort_values(["cy", "cx"]).reset_index(drop=True)
    at = {(int(y), int(x)): i for i, (y, x) in enumerate(zip(order["cy"], order["cx"]))}
    found = [-1] * len(order)
    for i in range(len(order)):
        if found[i] < 0:
            found[i], stack = i, [i]
            while stack:
                y, x = int(order["cy"][stack[-1]]), int(order["cx"][stack.pop()])
                for near in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    j = at.get(near)
                    if j is not None and found[j] < 0:
                        found[j] = i
                        stack.append(j)
    return order.assign(component=found)


def top_components(cells: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Mass and cell bounds of each page's heaviest components, at least 3 % of its points and 500."""
    sums = cells.groupBy(*keys, "component").agg(F.sum("n").alias("mass"), F.min("cx").alias("x0"), F.min("cy").alias("y0"), (F.max("cx") + 1).alias("x1"), (F.max("cy") + 1).alias("y1"))
    total = F.sum("mass").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mass"), "component"))
    return sums.withColumns({"_total": total, "_rank": rank}).where((F.col("mass") >= F.greatest(F.lit(500), F.col("_total") * 0.03)) & (F.col("_rank") <= most)).drop("_total", "_rank")
