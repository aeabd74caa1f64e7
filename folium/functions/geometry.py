"""Boxes in 0..1000 page units, as structs of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
LEAST_SIDE, UNIT = 15, 1000


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))


def clamped(b: Column) -> Column:
    """Within the page, corners in order."""
    x0, y0, x1, y1 = (F.least(F.greatest(b[s], F.lit(0)), F.lit(UNIT)) for s in SIDES)
    return box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0)) * F.greatest(b["y1"] - b["y0"], F.lit(0))


def usable(b: Column) -> Column:
    """F8"""
    return (b["x1"] - b["x0"] >= LEAST_SIDE) & (b["y1"] - b["y0"] >= LEAST_SIDE)


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def reading_key(b: Column) -> Column:
    """O1: top to bottom, then left to right."""
    return F.struct((b["y0"] + b["y1"]).alias("y"), (b["x0"] + b["x1"]).alias("x"))


def strip_to_page(y: Column, top: Column, height: Column, page_height: Column) -> Column:
    """A strip's y in page units; halves go to the even number."""
    return F.bround((top + y / F.lit(float(UNIT)) * height) / page_height * UNIT).cast("int")


def unpadded(v: Column, pad: Column, scale: Column, size: Column) -> Column:
    """A coordinate read from a padded, scaled picture, on the picture itself."""
    canvas = size * scale + pad * 2
    return F.least(F.greatest(F.bround((v / F.lit(float(UNIT)) * canvas - pad) / (size * scale) * UNIT), F.lit(0)), F.lit(UNIT)).cast("int")


def figure_width(b: Column) -> Column:
    """Share of the text block that a figure takes, two decimals."""
    frac = (b["x1"] - b["x0"]) / F.lit(float(UNIT)) / 0.86 * 0.82
    return F.format_string("%.2f", F.least(F.greatest(frac, F.lit(0.20)), F.lit(0.78)))


def figure_command(page: Column, k: Column, b: Column) -> Column:
    """What takes the place of the k-th marker of a page."""
    name = F.format_string("p%04d_f%d.png", page, k)
    shown = F.concat(F.lit(r"\begin{center}\includegraphics[width="), figure_width(b), F.lit(r"\linewidth]{"), name, F.lit(r"}\end{center}"))
    return F.when(usable(b), shown).otherwise(r"\textit{[figure omitted]}")


def parsed_boxes(reply: Column) -> Column:
    """Array of clamped boxes from a reply with a JSON list; items are lists or have bbox or bbox_2d, bad ones go."""
    body = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    items = F.from_json(body, "array<string>", {"mode": "PERMISSIVE"})
    numbers = lambda x: F.from_json(F.coalesce(F.get_json_object(x, "$.bbox"), F.get_json_object(x, "$.bbox_2d"), x), "array<double>")
    four = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), numbers), lambda a: a.isNotNull() & (F.size(a) == 4) & F.forall(a, lambda v: v.isNotNull()))
    return F.transform(four, lambda a: clamped(box(*[F.bround(a[i]) for i in range(4)])))


def seam(cut: Column, upper: Column, lower: Column, near: int = 20) -> Column:
    """Whether a figure that ends one strip and one that begins the next are one, cut at ``cut``."""
    overlap = F.least(upper["x1"], lower["x1"]) - F.greatest(upper["x0"], lower["x0"])
    narrower = F.greatest(F.least(upper["x1"] - upper["x0"], lower["x1"] - lower["x0"]), F.lit(1))
    return (F.abs(upper["y1"] - cut) <= near) & (F.abs(lower["y0"] - cut) <= near) & (overlap >= narrower * 0.5)


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), a["y0"], F.greatest(a["x1"], b["x1"]), b["y1"])
