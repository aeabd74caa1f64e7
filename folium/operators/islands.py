"""Runs and streaks over ordered rows: gaps and islands by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], at: str, apart: Column) -> DataFrame:
    """``rows`` with ``island``: a number that grows where ``apart`` holds between a row and the one before it.

    ``apart`` may use ``prev``, the former row's ``at``; the first row of a key begins island 0.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    marked = rows.withColumn("prev", F.lag(at).over(w)).withColumn("_new", F.when(F.col("prev").isNotNull() & apart, 1).otherwise(0))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "prev")


def _runs(profile: DataFrame, keys: list[str], gap: int, at: str, ink: str) -> DataFrame:
    found = islands(profile.where(F.col(ink) > 0), keys, at, F.col(at) - F.col("prev") > gap)
    return found.groupBy(*keys, "island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("stop")).drop("island")


def ink_runs(profile: DataFrame, keys: list[str], gap: int = 2, least: int = 4, at: str = "y", ink: str = "ink") -> DataFrame:
    """Half-open runs (start, stop) of rows with ink, split where ``gap`` or more blank rows lie between.

    A run that fewer than ``gap`` blank rows follow at the page's end reaches to the end.
    """
    ends = profile.groupBy(*keys).agg((F.max(at) + 1).alias("_end"))
    stop = F.when(F.col("_end") - F.col("stop") < gap, F.col("_end")).otherwise(F.col("stop"))
    runs = _runs(profile, keys, gap, at, ink).join(ends, keys).select(*keys, "start", stop.alias("stop"))
    return runs.where(F.col("stop") - F.col("start") >= least)


def merged_bands(profile: DataFrame, keys: list[str], gap: int, at: str = "y", ink: str = "ink") -> DataFrame:
    """Runs of ink, those with fewer than ``gap`` clear rows between them as one."""
    return _runs(profile, keys, max(gap, 1), at, ink)


def row_bands(profile: DataFrame, keys: list[str], gap: int, at: str = "y", ink: str = "ink", height: str = "height") -> DataFrame:
    """Bands split by ``gap`` blank rows; a band that the page's end cuts off stops a row early."""
    runs = _runs(profile, keys, gap, at, ink)
    ends = profile.groupBy(*keys).agg((F.max(at) + 1).alias(height))
    cut = F.when(F.col(height) - F.col("stop") < gap, F.col(height) - 1).otherwise(F.col("stop"))
    return runs.join(ends, keys).select(*keys, "start", cut.alias("stop"))


def table_bands(profile: DataFrame, keys: list[str], coverage: float = 0.55, least_rules: int = 4, at: str = "y", ink: str = "coverage") -> DataFrame:
    """I14 and W1d: (top, bottom, n_rules) of ruled tables in pages' row coverage.

    Rows of enough coverage at most 3 apart are one rule; rules no farther apart than an eighth of
    the page, 40 rows at least, are one table; tables with few rules go.
    """
    pages = profile.groupBy(*keys).agg((F.max(at) + 1).alias("height"))
    dark = islands(profile.where(F.col(ink) >= coverage), keys, at, F.col(at) - F.col("prev") > 3)
    rules = dark.groupBy(*keys, "island").agg(F.min(at).alias("top"), F.max(at).alias("bottom")).join(F.broadcast(pages) if not keys else pages, keys)
    w = Window.partitionBy(*keys).orderBy("top")
    limit = F.greatest(F.lit(40), F.floor(F.col("height") * 0.12))
    grouped = rules.withColumn("_new", F.when(F.col("top") - F.lag("bottom").over(w) > limit, 1).otherwise(0)).withColumn(
        "table", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    pad = F.floor(F.col("height") * 0.01).cast("long")
    found = grouped.groupBy(*keys, "table", "height").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("n_rules"))
    return found.where(F.col("n_rules") >= least_rules).select(
        *keys, F.greatest(F.col("top") - pad, F.lit(0)).alias("top"), F.least(F.col("bottom") + pad, F.col("height")).alias("bottom"), "n_rules"
    )


def biggest_table(bands: DataFrame, keys: list[str]) -> DataFrame:
    """O3: the table of most rules of each page, the first where several have as many."""
    best = F.max(F.struct("n_rules", (-F.col("top")).alias("order"), "top", "bottom")).alias("best")
    return bands.groupBy(*keys).agg(best).select(*keys, "best.top", "best.bottom", "best.n_rules")


def failure_streaks(rows: DataFrame, keys: list[str], at: str, failed: Column, succeeded: Column, start: Column | int = 0) -> DataFrame:
    """``rows`` with ``streak``: failures since the last success; rows that are neither don't change it.

    ``start`` is the streak that the first rows inherit. Ordering by completion gives W6.
    """
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    inherited = F.lit(start) if isinstance(start, int) else start
    marked = rows.withColumns({"_bad": F.coalesce(failed, F.lit(False)).cast("int"), "_good": F.coalesce(succeeded & ~F.coalesce(failed, F.lit(False)), F.lit(False)).cast("int")})
    parts = marked.withColumn("_part", F.sum("_good").over(w))
    own = Window.partitionBy(*keys, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum("_bad").over(own) + F.when(F.col("_part") == 0, inherited).otherwise(0)
    return parts.withColumn("streak", streak.cast("long")).drop("_bad", "_good", "_part")


def breaker_trips(streaks: DataFrame, keys: list[str], at: str, most: int = 3) -> DataFrame:
    """The first row of each key at which ``most`` failures in a row are reached."""
    return streaks.where(F.col("streak") >= most).groupBy(*keys).agg(F.min(at).alias("tripped_at"))


def after_trip(rows: DataFrame, trips: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``rows`` with ``skipped``: later than the trip, which stays tripped."""
    return rows.join(trips, keys, "left").withColumn("skipped", F.coalesce(F.col(at) > F.col("tripped_at"), F.lit(False)))


def repeats(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``rows`` with ``repeats``: how many rows directly before have the same value."""
    w = Window.partitionBy(*keys).orderBy(at)
    marked = rows.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    parts = marked.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.withColumn("repeats", (F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(at)) - 1).cast("long")).drop("_new", "_part")


def pitch(runs: DataFrame, keys: list[str], stripe: str = "stripe", least: int = 4) -> DataFrame:
    """The median over stripes of the median distance between centres of runs."""
    w = Window.partitionBy(*keys, stripe).orderBy("start")
    centre = (F.col("start") + F.col("stop")) / 2
    gaps = runs.withColumn("gap", centre - F.lag(centre).over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys, stripe)))
    each = gaps.where(F.col("n") >= least).groupBy(*keys, stripe).agg(F.median("gap").alias("pitch"))
    return each.groupBy(*keys).agg(F.median("pitch").alias("pitch"))


def line_count(runs: DataFrame, keys: list[str], stripe: str = "stripe") -> DataFrame:
    """The median, cut to a whole number, of runs in the stripes that have any."""
    return runs.groupBy(*keys, stripe).count().groupBy(*keys).agg(F.floor(F.median("count")).cast("int").alias("lines"))


def low_quartile(rows: DataFrame, keys: list[str], value: str, least: int = 3, otherwise: Column | int = 8) -> DataFrame:
    """The element a quarter up the sorted values, 8 at least; another where there are few."""
    v = F.sort_array(F.collect_list(value))
    picked = rows.groupBy(*keys).agg(v.alias("v"))
    height = F.greatest(F.get("v", F.floor(F.size("v") / 4).cast("int")), F.lit(8))
    return picked.select(*keys, F.when(F.size("v") < least, otherwise).otherwise(height).alias("height"))


def upper_middle(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A4: the middle of the sorted values, the upper one of two."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v")).select(*keys, F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("middle"))


def needs_strips(pages: DataFrame, edge: int = 1600, legible: int = 45) -> DataFrame:
    """``pages`` (pitch, width, height) with ``dense``: lines too close at the size a reader gets."""
    return pages.withColumn("dense", F.coalesce(F.col("pitch") * edge / F.greatest("width", "height") < legible, F.lit(False)))
