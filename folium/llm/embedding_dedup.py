"""Near-duplicate vectors by p-stable hashing with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import apart, connected_components, saved

#: At cosine 0.98 (distance 0.2) a pair meets in a table with probability 0.90**16, in none of 64 in 1 of 500,000.
TABLES, PROJECTIONS, WIDTH = 64, 16, 1.6
#: Vectors that one task compares with each other at once.
BLOCK = 1024
#: Pairs of them whose keys are compared at once.
PAIRS = 16_384


def hash_keys(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """64-bit bucket keys (rows x tables): quantised Gaussian projections, folded with odd multipliers."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    lines = rng.standard_normal((unit.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    odd = rng.integers(0, 2**63, tables * projections, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    cells = np.floor((unit @ lines + shift) / width).astype(np.int64).astype(np.uint64) * odd
    return cells.reshape(len(unit), tables, projections).sum(axis=2, dtype=np.uint64).view(np.int64)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _links(group: list[dict], table: int, threshold: float) -> dict[str, list]:
    """For one block pair of a bucket: links counted here, and a root, for each class that has any.

    A pair is counted in the first table in which it meets; roots join all that link here.
    """
    unit = unit_rows(np.array([r["vec"] for r in group], dtype=np.float64))
    keys, n, side = np.array([r["keys"] for r in group]), np.array([r["n"] for r in group]), np.array([r["side"] for r in group])
    near = unit @ unit.T >= threshold
    near &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    first = np.empty(len(a), dtype=bool)
    for at in range(0, len(a), PAIRS):
        part = slice(at, at + PAIRS)
        first[part] = np.argmax(keys[a[part]] == keys[b[part]], axis=1) == table
    links = np.zeros(len(group), dtype=np.int64)
    np.add.at(links, a[first], n[b[first]])
    root = np.arange(len(group))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[low]
        if (low == root).all():
            break
        root = low
    cls = [r["cls"] for r in group]
    who = np.flatnonzero(near.any(axis=1))
    return {"cls": [cls[i] for i in who], "links": links[who].tolist(), "root": [cls[root[i]] for i in who]}


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK, seed: int = 42,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors with equal labels link at a cosine of ``threshold`` or more. Equal vectors are one
    class with a multiplicity. Each class is hashed into ``tables`` tables; buckets of two or more
    classes are compared exactly, large ones as pairs of blocks, and only each class's number of
    links and one root leave the task, never the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a
    null label, have no links and stay; vectors of different lengths don't link. Rows that repeat
    an id count each other as links. A component's id is its least non-null id; the row with that
    id is kept, so is a null id in a component without another. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    size = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0), F.lit(False)
    )
    rows = rows.withColumn("usable", usable)
    classes = saved(
        rows.where("usable").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes",
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list] = {}
            for cls, vec in zip(batch.column("cls").to_pylist(), batch.column("vec").to_pylist()):
                by_length.setdefault(len(vec), []).append((cls, vec))
            for found in by_length.values():
                keys = hash_keys(unit_rows(np.array([v for _, v in found])), tables, projections, width, seed)
                yield pa.RecordBatch.from_pydict({"cls": [c for c, _ in found], "keys": list(keys)}, schema=pa.schema([("cls", pa.int64()), ("keys", pa.list_(pa.int64()))]))

    keys = saved(classes.select("cls", "vec").mapInArrow(hashed, "cls long, keys array<long>"), "keys")
    placed = (
        keys.join(classes.select("cls", "label", F.size("vec").alias("length")), "cls")
        .select("cls", "label", "length", F.posexplode("keys").alias("t", "key"))
        .withColumn("bucket", F.xxhash64("label", "length", "t", "key"))
    )
    counts = placed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select(apart(F.col("bucket")).alias("k"), "m")
    shared = saved(placed.withColumn("k", apart(F.col("bucket"))).join(counts, "k").select("cls", "t", "bucket", "m"), "shared")
    blocks = F.ceil(F.col("m") / block).cast("int")
    dealt = (
        shared.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("cls", "t"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "cls", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), F.lit(-1)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
        )
    )
    facts = classes.select("cls", "n", "vec").join(keys, "cls").select(F.col("cls").alias("c"), "n", "vec", "keys")
    groups = (
        dealt.join(facts, F.col("cls") == F.col("c"))
        .groupBy("bucket", "t", "i", "j")
        .agg(F.collect_list(F.struct("cls", "n", "side", "vec", "keys")).alias("found"))
        .where(F.size("found") > 1)
        .select("t", "found")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        for batch in batches:
            for t, group in zip(batch.column("t").to_pylist(), batch.column("found")):
                yield pa.RecordBatch.from_pydict(_links(group.as_py(), t, threshold), schema=schema)

    found = saved(groups.mapInArrow(compared, "cls long, links long, root long"), "links")
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = saved(
        classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left")
        .select("label", "vec", "rep", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "known",
    )
    least = known.groupBy("root").agg(F.min("rep").alias("component_id")).select(apart(F.col("root")).alias("k"), "component_id")
    known = saved(known.withColumn("k", apart(F.col("root"))).join(least, "k").select("label", "vec", "n_links", "component_id"), "classes-done")
    done = rows.where("usable").join(known, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
