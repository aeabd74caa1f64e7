"""What the operators share: tables in the cluster's shared folder, ASCII folding, connected components."""

from __future__ import annotations

import atexit
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
    own = "file://" + tempfile.mkdtemp(prefix="folium-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/folium-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): each row of ``docs`` as a struct, with a number that stays as it is written once."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return saved(rows, "numbered")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_saved(df: DataFrame) -> None:
    """Deletes the table that ``saved`` wrote; ``df`` can't be read after it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


@atexit.register
def release() -> None:
    """Deletes every table written here so far; results that read them must have been used before."""
    while _written:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            return


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` does the same on pure ASCII and is much faster."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def apart(key: Column) -> Column:
    """The same key in a form whose partitioning Catalyst doesn't recognise.

    A join on it gets exchanges of its own on both sides, which adaptive execution can split
    where a key is hot; reusing an aggregate's partitioning would rule that out.
    """
    return key.bitwiseXOR(F.lit(0x5BD1E9955BD1E995))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges(a long, b long)``: (node, root), root the least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each an aggregation with
    map-side partials and a join that adaptive execution splits at hubs; every round is a table
    in the shared folder, so a lost executor costs one round. Loops and repeated edges are fine;
    edges with a null end are left out; no edges give no rows.
    """

    def step(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(apart(F.col("u")).alias("k"), "m")
        large = (
            e.withColumn("k", apart(F.col("v")))
            .join(low, "k", "left")
            .select("u", F.coalesce("m", "v").alias("v"))
            .where("u <> v")
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.withColumn("k", apart(F.col("u")))
            .join(least.select(apart(F.col("u")).alias("k"), "m"), "k")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = mark(now)
    while seen[0]:
        then = saved(step(now), "edges")
        drop_saved(now)
        now, before, seen = then, seen, mark(then)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
