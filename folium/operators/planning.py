"""Where a dense page is cut into strips, and what becomes of the strips' readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: A band over this part of a page's height is cut through: it would leave nowhere to cut.
TALLEST_BAND = 0.4


def low_bands(bands: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """the ``bands`` [top, bottom) that protect their rows; ``pages`` has (height)."""
    return bands.join(pages.select(*keys, F.col("height").alias("_height")), keys).where(F.col("bottom") - F.col("top") <= F.col("_height") * TALLEST_BAND).drop("_height")


def protected_bands(tables: DataFrame, regions: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The bands [top, bottom) that no cut may pass: ruled tables and coloured regions, unless too tall.

    ``tables`` has (top, bottom), ``regions`` (y0, y1), ``pages`` (height, pitch). A region gets half
    a line's pitch around it, or half a hundredth of the page where the pitch isn't known.
    """
    pad = F.floor(F.coalesce("pitch", F.col("height") * 0.01) * 0.5)
    around = regions.select(*keys, "y0", "y1").join(pages.select(*keys, "height", pad.alias("pad")), keys)
    padded = around.select(*keys, F.greatest(F.col("y0") - F.col("pad"), F.lit(0)).alias("top"), F.least(F.col("y1") + F.col("pad"), F.col("height")).alias("bottom"))
    return low_bands(tables.select(*keys, "top", "bottom").unionByName(padded), pages, keys)


def cut_candidates(profile: DataFrame, pages: DataFrame, bands: DataFrame | None, keys: list[str]) -> DataFrame:
    """(k, y) for each cut that a page needs: the emptiest row near its target, then the nearest, then the first.

    ``profile`` has (y, ink), ``pages`` (height, n): strips wanted; rows in a band [top, bottom) of
    ``bands`` can't be cut, if the band is low enough.
    """
    if bands is not None:
        b = low_bands(bands, pages, keys).select(*keys, F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
        inside = [profile[k] == b[k] for k in keys] + [(profile["y"] >= b["_top"]) & (profile["y"] < b["_bottom"])]
        profile = profile.join(b, inside, "left_anti")
    step = F.col("height") / F.col("n")
    targets = pages.where("n > 1").select(*keys, "height", "n", F.explode(F.sequence(F.lit(1), (F.col("n") - 1).cast("int"))).alias("k"))
    targets = targets.withColumns({"target": F.floor(F.col("k") * step), "window": F.floor(step * 0.4)})
    near = (F.col("y") >= F.greatest(F.col("target") - F.col("window"), F.lit(1))) & (F.col("y") < F.least(F.col("target") + F.col("window"), F.col("height") - 1))
    best = F.min(F.struct("ink", F.abs(F.col("y") - F.col("target")).alias("away"), "y")).alias("best")
    return profile.join(targets, keys).where(near).groupBy(*keys, "k", "height").agg(best).select(*keys, "k", "height", F.col("best.y").alias("y"))


def strips(cuts: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open strips (strip, top, bottom) of each page.

    A cut holds only if it is more than two pitches below the last one that holds, so cuts are
    folded in order; ``pages`` has (height, pitch).
    """
    found = cuts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "y"))).alias("cuts"))
    page = pages.join(found, keys, "left")
    fold = F.aggregate(
        F.coalesce("cuts", F.array().cast("array<struct<k:int,y:long>>")),
        F.array().cast("array<long>"),
        lambda kept, c: F.when((F.size(kept) == 0) | (c["y"] - F.element_at(kept, -1) > F.col("pitch") * 2), F.array_append(kept, c["y"].cast("long"))).otherwise(kept),
    )
    edges = F.concat(F.array(F.lit(0).cast("long")), F.when(F.col("pitch").isNull(), F.array().cast("array<long>")).otherwise(fold), F.array(F.col("height").cast("long")))
    out = page.withColumn("edges", edges).select(*keys, F.posexplode(F.slice("edges", 2, F.size("edges") - 1)).alias("i", "bottom"), "edges")
    return out.select(*keys, (F.col("i") + 1).alias("strip"), F.get("edges", F.col("i")).alias("top"), "bottom").where("bottom > top")


def best_reads(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The reading to keep of each strip's (variant, ok, score): the first that is ok, else the best score, earliest first.

    Readings after the first that is ok are not looked at; a score of 0 is never kept.
    """
    w = Window.partitionBy(*keys).orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)
    tried = reads.withColumn("_done", F.coalesce(F.max(F.col("ok").cast("int")).over(w), F.lit(0))).where("_done = 0 and score > 0")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "variant")
    return tried.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_done")


def missing_strips(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """J13"""
    return planned.join(done, keys, "left_anti")


#: Pixels of white around a strip and its scale, in the order in which re-reads try them.
VARIANTS = ((0, 1.0), (0, 0.6), (40, 0.8), (96, 1.0), (0, 0.5), (64, 0.7))


def strip_variants(planned: DataFrame) -> DataFrame:
    """Each strip once for each variant (variant, pad, scale)."""
    table = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(p).alias("pad"), F.lit(s).alias("scale")) for i, (p, s) in enumerate(VARIANTS)])
    return planned.withColumn("v", F.explode(table)).select(*planned.columns, "v.*")


def seam_merges(figures: DataFrame, keys: list[str]) -> DataFrame:
    """``figures`` (strip, i, box, cut): markers in order, ``cut`` the lower edge of their strip in page units.

    The last marker of a strip and the first of the next become one where ``geometry.seam`` holds.
    Strips are taken in order, and a marker that went into the one before it is no longer there to take
    the next: of a chain of strips with one marker each, the first and second become one, the third and
    fourth, and so on; an odd last one stays as it is.
    """
    from folium.functions.geometry import seam, union

    page = Window.partitionBy(*keys).orderBy("strip", "i")
    one = Window.partitionBy(*keys, "strip")
    marked = figures.withColumns(
        {
            "_last": F.col("i") == F.max("i").over(one),
            "_first": F.col("i") == F.min("i").over(one),
            "_next": F.lead("box").over(page),
            "_next_strip": F.lead("strip").over(page),
            "_before": F.lag("box").over(page),
            "_before_strip": F.lag("strip").over(page),
            "_before_cut": F.lag("cut").over(page),
        }
    )
    joins = F.col("_last") & (F.col("_next_strip") == F.col("strip") + 1) & seam(F.col("cut"), F.col("box"), F.col("_next"))
    joined = F.col("_first") & (F.col("_before_strip") == F.col("strip") - 1) & seam(F.col("_before_cut"), F.col("_before"), F.col("box"))
    out = marked.withColumns({"_joins": F.coalesce(joins, F.lit(False)), "_joined": F.coalesce(joined, F.lit(False))})
    # a chain goes on where the only marker of a strip could be joined on both sides
    begins = F.col("_joins") & ~(F.col("_first") & F.col("_joined"))
    out = out.withColumn("_chain", F.sum(begins.cast("int")).over(page))
    place = F.sum(F.col("_joins").cast("int")).over(Window.partitionBy(*keys, "_chain").orderBy("strip", "i"))
    out = out.withColumn("merged", F.col("_joins") & (place % 2 == 1))
    out = out.withColumn("gone", F.col("_first") & F.coalesce(F.lag("merged").over(page), F.lit(False)))
    return out.where("not gone").select(*keys, "strip", "i", F.when(F.col("merged"), union(F.col("box"), F.col("_next"))).otherwise(F.col("box")).alias("box"), "merged")


def join_strips(parts: DataFrame, keys: list[str], text: str = "latex") -> DataFrame:
    """The strips' texts of each page from top to bottom, blank ones left out."""
    from folium.functions.text import strip

    kept = parts.withColumn("_text", strip(F.col(text))).where("_text <> ''")
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("strip", "_text"))), lambda s: s["_text"]), "\n\n").alias(text))
