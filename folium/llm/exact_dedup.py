"""Exact duplicates by content-defined chunk recipes, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import ascii_lower, saved

#: A chunk ends at the first sentence end or line end after CHUNK_MIN characters, or at CHUNK_MAX.
CHUNK_MIN, CHUNK_MAX = 512, 4096


def chunk_pattern(least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> str:
    return rf"(?s).{{{least},{most - 1}}}?[.!?\n。।؟]|.{{1,{most}}}"


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, id_bits: int = 64
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A text becomes the ordered list of its
    chunks' identifiers, 64-bit hashes that a pass over the distinct chunks verifies to name one
    text each; chunks that share a hash get its rank among them beside it. Documents are equal
    when their lists are. Chunk text moves once, with repeats summed before the shuffle; later
    steps move lists of longs. ``id_bits`` under 64 weakens the hash, for tests.

    Null text counts as empty (its list is empty). Of a group the largest id stays; rows that
    repeat an id and text are all marked kept; a null id stays only where a group has no other.
    Other columns of ``docs`` are ignored, an empty table gives no rows.
    """
    cut = F.lit(pattern or chunk_pattern())
    norm = docs.select(
        F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm")
    )
    name = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << id_bits) - 1 if id_bits < 64 else -1))

    chunks = norm.select(F.explode(F.regexp_extract_all("norm", cut, F.lit(0))).alias("chunk"))
    distinct = chunks.select(name(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").agg(F.count("*").alias("n"))
    shared = saved(distinct.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "shared-names")

    lists = norm.select(
        "id",
        F.sha2("norm", 256).alias("sha"),
        F.transform(F.regexp_extract_all("norm", cut, F.lit(0)), name).alias("recipe"),
    )
    if shared.isEmpty():
        lists = lists.withColumn("ranks", F.array().cast("array<int>"))
    else:
        lists = _told_apart(norm, distinct, shared, cut, name)
    lists = saved(lists, "recipes")
    groups = saved(
        lists.groupBy("recipe", "ranks").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    return lists.join(groups, ["recipe", "ranks"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _told_apart(norm: DataFrame, distinct: DataFrame, shared: DataFrame, cut, name) -> DataFrame:
    """Lists for the case that some hash names several chunks: the chunk's rank among them goes beside it."""
    rank = (
        distinct.join(shared, "h")
        .groupBy("h")
        .agg(F.sort_array(F.collect_list("chunk")).alias("texts"))
        .select("h", F.posexplode("texts").alias("rank", "chunk"))
    )
    rows = saved(
        norm.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.sha2("norm", 256).alias("sha"),
            F.regexp_extract_all("norm", cut, F.lit(0)).alias("chunks"),
        ),
        "chunked",
    )
    parts = rows.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("h", name(F.col("chunk")))
    ranks = (
        parts.join(rank, ["h", "chunk"])
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("found"))
        .select("row", F.transform("found", lambda x: x["rank"]).alias("ranks"))
    )
    return rows.join(ranks, "row", "left").select(
        "id", "sha", F.transform("chunks", name).alias("recipe"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks")
    )
