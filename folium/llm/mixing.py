"""Mixing sources to target weights by systematic sampling, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import WORD, numbered, saved

#: Rows that one slice of a size class should hold at most, on average.
SLICE_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by raising one water level.

    Sources in code point order, null last, take the weights in turn. The targets split ``share``
    of all sizes by weight; none passes ``most`` times its source's size, the excess being shared
    again by weight. That is target = least(most * size, level * weight); the level follows from
    running sums over sources by most * size / weight. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_cap = Window.orderBy("full_at", "turn")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("turn", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double")
    )
    filled = (
        ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_here", F.col("left") / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level_here") <= F.col("full_at"), F.struct("full_at", "turn", "level_here"))).over(every))
    )
    return filled.select(
        "source",
        "source_size",
        F.least("cap", F.coalesce(F.col("level.level_here") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def size_class(size: Column) -> Column:
    """Sizes within a sixth of an octave share a class, so a class's documents weigh about the same."""
    return F.floor(F.log2(size + F.lit(1.0)) * F.lit(6.0)).cast("int")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, order_col: str | None = None, **targets
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies.

    Within a source the documents stand in order of size class; each has target / source_size
    expected copies, whose running sum is cut by one offset in [0, 1) for the source: a document
    is emitted once for each integer that its stretch crosses. Ordering by size lets the words
    taken come near the target; two copies are the most as no target passes twice its source.

    The running sum is taken in three steps, so no source meets in one task: rows are numbered
    within (source, size class, slice), the slices' counts are summed along a class, and the
    classes' counts, some hundred at most, along a source.

    Null text has size 0; a null source is a source; repeated ids are ordered like any other
    value, rows with a null id by their size. Sources without words have target 0 and copies 0. Reruns agree.
    """
    spark = docs.sparkSession
    rows = saved(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            (F.col(order_col) if order_col else F.lit(0)).alias("order"),
        ),
        "sizes",
    )
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn(
        "slice", F.pmod(F.coalesce(F.col("order") if order_col else F.col("id"), F.xxhash64("size")), F.lit(slices)).cast("int")
    )
    key = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))
    rows = rows.withColumn("key", key)
    groups = saved(rows.groupBy("key", "source", "class", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "groups")
    sources = source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), **targets).withColumn("key", key).drop("source")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = groups.groupBy("key", "class").agg(F.sum("n").alias("n"))
    classes = classes.select("key", "class", before(Window.partitionBy("key").orderBy("class")).alias("lower"))
    in_class = before(Window.partitionBy("key", "class").orderBy("slice"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("key"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    plan = groups.select("key", "class", "slice", in_class.alias("in_class")).join(classes, ["key", "class"])
    plan = plan.withColumn("ahead", F.col("lower") + F.col("in_class")).join(sources, "key").select(
        F.col("key").alias("k"), F.col("class").alias("c"), F.col("slice").alias("s"), "ahead", "source_size", "target", offset.alias("offset")
    )
    within = Window.partitionBy("key", "class", "slice").orderBy("size", "order", "id")
    numbered = rows.withColumn("nth", F.row_number().over(within))
    cut = lambda n: F.floor(F.col("offset") + n * F.col("rate"))
    return (
        numbered.join(plan, (F.col("key") == F.col("k")) & (F.col("class") == F.col("c")) & (F.col("slice") == F.col("s")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("upto", F.col("ahead") + F.col("nth"))
        .select(
            F.col("id").alias(id_col),
            F.col("source").alias(source_col),
            "size",
            "source_size",
            "target",
            (cut(F.col("upto")) - cut(F.col("upto") - 1)).cast("int").alias("copies"),
        )
    )


def mixed(docs: DataFrame, seed: int = 42, **names) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; same columns.

    Rows get a number of their own in a table first, so that repeated ids and rows stay apart. They are
    ordered by a hash of all their columns, so the mix doesn't depend on how the rows lie in partitions.
    """
    rows = numbered(docs)
    text_col, source_col = (names.get(k, v) for k, v in (("text_col", "text"), ("source_col", "source")))
    keyed = rows.select(
        F.col("row").alias("id"), F.col(f"doc.`{text_col}`").alias("text"), F.col(f"doc.`{source_col}`").alias("source"),
        F.xxhash64("doc").alias("order"),
    )
    copies = mix(keyed, "id", "text", "source", seed, order_col="order").where("copies > 0").select(F.col("id").alias("row"), "copies")
    return (
        rows.join(copies, "row")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc.*")
    )
