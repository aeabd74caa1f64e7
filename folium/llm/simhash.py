"""SimHash near-duplicates: every pair within the radius is found by covering bit masks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import apart, connected_components, numbered, saved

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Of the stage that leaves one document of each group. Sets of a Jaccard similarity of 0.8 have prints that differ in 9.7
#: of 64 bits on the mean, so the radius is wide; what it lets meet is compared exactly.
STAGE_SHINGLE, STAGE_RADIUS, SIMILARITY = 5, 11, (4, 5)
#: Fingerprints that a bucket may hold before it is split by further masks.
BUCKET = 2048


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    line = b" ".join(found)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(line, seed)]
    else:
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2**(radius+1)-1 masks over the bit positions ``bits`` such that any ``radius`` of them are unmasked in one.

    Covering code (Pagh, 2016): bit i gets a nonzero vector of radius+1 bits, mask v keeps the bits
    whose vector has an odd product with v. Any ``radius`` vectors leave some v orthogonal to all.
    """
    most = 2 ** (radius + 1)
    return [sum(1 << b for i, b in enumerate(bits) if (v & (i % (most - 1) + 1)).bit_count() % 2) for v in range(1, most)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def joined(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct uint64 ``prints`` the index of its component's first one, links at ``radius``."""
    root, left = np.full(len(prints), -1), np.arange(len(prints))
    while len(left):
        first = left[0]
        front, left = left[:1], left[1:]
        root[first] = first
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(front), 64):
                gap = np.bitwise_count(prints[front[at : at + 64], None] ^ prints[None, left])
                near |= (gap <= radius).any(axis=0)
            front, left = left[near], left[~near]
            root[front] = first
    return root


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], ["id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, print long")


def _bucket_edges(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (path, key, print) of buckets of bounded size to edges (a, b) that span each bucket's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b = [], []
            for found in batch.column(0):
                prints = np.sort(found.values.to_numpy())
                if len(prints) == 2 and int(prints.view(np.uint64)[0] ^ prints.view(np.uint64)[1]).bit_count() > radius:
                    continue
                root = joined(prints.view(np.uint64), radius)
                far = np.flatnonzero(root != np.arange(len(prints)))
                a += prints[far].tolist()
                b += prints[root[far]].tolist()
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    return rows.groupBy("path", "key").agg(F.collect_list("print").alias("found")).select("found").mapInArrow(run, "a long, b long")


def print_edges(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct 64-bit ``prints`` (print long) just as all links do.

    Each print goes to one bucket for each mask. Buckets of up to ``bucket`` prints are solved in a
    task. Those of larger ones go to a bucket for each covering mask of the bits not yet compared;
    as prints are distinct and at most 32 bits stay free at first, 17 after that, a bucket is
    bounded then. No pairs are emitted: a bucket of n gives at most n - 1 edges.
    """
    first = covering_masks(list(range(64)), radius)
    second = [[m | x for x in covering_masks([b for b in range(64) if not m >> b & 1], radius)] for m in first]
    spread = lambda masks: F.array(*[F.lit(signed(m)) for m in masks])
    placed = prints.select("print", F.posexplode(spread(first)).alias("path", "mask")).select(
        "print", "path", F.col("print").bitwiseAND(F.col("mask")).alias("key")
    )
    groups = _shared(placed, "buckets")
    out = _bucket_edges(groups.where(F.col("n") <= bucket), radius)
    large = groups.where(F.col("n") > bucket)
    if not large.isEmpty():
        again = large.select(
            "print", "path", F.posexplode(F.element_at(F.array(*map(spread, second)), F.col("path") + 1)).alias("way", "mask")
        ).select("print", (F.col("path") * F.lit(100) + F.col("way") + F.lit(100)).alias("path"), F.col("print").bitwiseAND(F.col("mask")).alias("key"))
        out = out.unionByName(_bucket_edges(_shared(again, "buckets-again"), radius))
    return out


def _shared(placed: DataFrame, name: str) -> DataFrame:
    """The rows of buckets of two or more, with the bucket's count; a hot bucket's rows can be split by the join."""
    counts = placed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
    counts = counts.select(F.col("path").alias("p"), apart(F.col("key")).alias("k"), "n")
    rows = placed.withColumn("k", apart(F.col("key")))
    return saved(rows.join(counts, (F.col("path") == F.col("p")) & (rows["k"] == counts["k"])).select("print", "path", "key", "n"), name)


def near_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    A fingerprint bit is 1 if set in over half the XXH64 hashes (seed 42) of the text's word
    shingles, repeats included, A-Z lower-cased; a text with fewer words has one shingle, one
    without words (null too) fingerprint zero. Fingerprints link at ``radius`` or fewer differing
    bits; component_id is the least non-null id reachable, null where there is none. Rows that
    repeat an id are in one row each. An empty table gives no rows.
    """
    rows = saved(_fingerprints(docs, id_col, text_col, words), "prints")
    known = saved(rows.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    edges = print_edges(known.select("print"), radius, bucket)
    roots = connected_components(edges).withColumnRenamed("node", "print")
    known = saved(known.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id")).select(apart(F.col("root")).alias("k"), "component_id")
    known = saved(known.withColumn("k", apart(F.col("root"))).join(least, "k").select("print", "component_id"), "components")
    return rows.join(known, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def wide_masks(bits: list[int], radius: int) -> list[int]:
    """Masks such that any ``radius`` of the positions ``bits`` are unmasked in one, for a large radius.

    The bits are cut into parts so that one part has RADIUS differing bits at most, and each part is covered.
    """
    parts = radius // (RADIUS + 1) + 1
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [m for a, b in zip(cuts, cuts[1:]) for m in covering_masks(bits[a:b], RADIUS)]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the runs of so many words, A-Z lower-cased; fewer words are one run, none without words."""
    found = text.lower().split()
    runs = (b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), dtype="<u8"))


def _bytes(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _named_prints(texts: DataFrame, words: int) -> DataFrame:
    """(row, name, print, size): equal words in equal order have equal names; print and size are of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bytes(t) for t in batch.column("text")]
            names = pa.array([xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in found], pa.binary())
            sets = [shingle_set(t, words) for t in found]
            prints, sizes = pa.array([signed(majority(x)) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), names, prints, sizes], ["row", "name", "print", "size"])

    return texts.mapInArrow(run, "row long, name binary, print long, size long")


def near_in_bucket(prints: np.ndarray, roots: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Index pairs within ``radius`` to compare in a bucket of distinct uint64 ``prints``: without ``roots`` each print
    and its nearest; with them, each print and the nearest of each other root."""
    out = []
    for at in range(0, len(prints), 64):
        gap = np.bitwise_count(prints[at : at + 64, None] ^ prints[None, :])
        if roots is None:
            gap[np.arange(len(gap)), np.arange(at, at + len(gap))] = 99
            best = gap.argmin(axis=1)
            out += [(at + i, int(j)) for i, j in enumerate(best) if gap[i, j] <= radius]
            continue
        for i in np.flatnonzero(((gap <= radius) & (roots[at : at + 64, None] != roots[None, :])).any(axis=1)):
            there = np.flatnonzero((gap[i] <= radius) & (roots != roots[at + i]))
            there = there[np.argsort(gap[i, there], kind="stable")]
            out += [(at + int(i), int(there[k])) for k in np.unique(roots[there], return_index=True)[1]]
    return out


def _bucket_pairs(placed: DataFrame, radius: int, rooted: bool) -> DataFrame:
    """Rows (bucket, print, root) of buckets of bounded size to pairs (a, b) of prints to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b = [], []
            for found in batch.column(0):
                prints = found.values.field("print").to_numpy() if rooted else found.values.to_numpy()
                if len(prints) < 2:
                    continue
                roots = found.values.field("root").to_numpy() if rooted else None
                for i, j in near_in_bucket(prints.view(np.uint64), roots, radius):
                    a.append(int(min(prints[i], prints[j])))
                    b.append(int(max(prints[i], prints[j])))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    held = F.struct("print", "root") if rooted else F.col("print")
    listed = placed.groupBy("bucket").agg(F.collect_list(held).alias("found")).where(F.size("found") > 1).select("found")
    return listed.mapInArrow(run, "a long, b long").distinct()


def similar_prints(prints: DataFrame, radius: int, rooted: bool, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of the distinct ``prints`` (print, root, size) to compare: all within ``radius`` meet in some bucket.

    Sets of such a similarity have sizes of 4 to 5 at most, so a bucket holds two size classes, each print being in
    two. Buckets over ``bucket`` prints are masked again over the bits not yet compared, until none is left over.
    """
    first = F.array(*[F.lit(signed(m)) for m in wide_masks(list(range(64)), radius)])
    size = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(1.25) + 1e-9)
    placed = prints.select("print", "root", F.explode(F.array(size, size + 1)).alias("class"), first.alias("masks"))
    placed = placed.select("print", "root", "class", F.posexplode("masks").alias("way", "mask"))
    # one number for what tells a bucket keeps the rows short; two buckets that share it by chance only compare more
    bucket_of = lambda *path: F.xxhash64(*path, F.col("print").bitwiseAND(F.col("mask"))).alias("bucket")
    placed = placed.select("print", "root", "mask", bucket_of("class", "way"))
    deeper = F.udf(lambda m: [signed((m & 2**64 - 1) | x) for x in wide_masks([b for b in range(64) if not m >> b & 1], radius)], "array<long>")
    out = None
    while True:
        # a mask with under 12 bits left isn't covered again: 2 ** 11 prints at most can share such a bucket
        counts = placed.where(F.bit_count("mask") <= 52).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        large = saved(counts.select(apart(F.col("bucket")).alias("k")), "large-buckets")
        n_large = large.count()
        large = F.broadcast(large) if n_large <= 1_000_000 else large
        mine = apart(F.col("bucket")) == F.col("k")
        found = _bucket_pairs(placed.join(large, mine, "left_anti") if n_large else placed, radius, rooted)
        out = found if out is None else out.unionByName(found)
        if not n_large:
            return out.distinct()
        rest = saved(placed.join(large, mine, "left_semi"), "large-rows")
        kinds = rest.select("mask").distinct().select("mask", deeper("mask").alias("masks"))
        rest = rest.select("print", "root", "bucket", "mask").join(F.broadcast(kinds), "mask")
        rest = rest.select("print", "root", "bucket", F.posexplode("masks").alias("way", "mask"))
        placed = rest.select("print", "root", "mask", bucket_of("bucket", "way"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) of rows whose texts' sets of shingles have that Jaccard similarity."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both * similarity[1] >= (len(x) + len(y) - both) * similarity[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [alike(shingle_set(_bytes(x), words), shingle_set(_bytes(y), words)) for x, y in zip(batch.column("a_text"), batch.column("b_text"))]
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    side = lambda c: texts.select(apart(F.col("row")).alias(f"{c}_key"), F.col("text").alias(f"{c}_text"))
    keyed = saved(pairs.where("a <> b").distinct(), "document-pairs").withColumns({"a_key": apart(F.col("a")), "b_key": apart(F.col("b"))})
    both = keyed.join(side("a"), "a_key").join(side("b"), "b_key").select("a", "b", "a_text", "b_text")
    return saved(both.mapInArrow(run, "a long, b long"), "document-links")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = STAGE_SHINGLE, similarity: tuple[int, int] = SIMILARITY,
    radius: int = STAGE_RADIUS,
) -> DataFrame:
    """The row of least id of each component of ``docs``, just one; same columns.

    Rows link if their words are the same, or if the prints of their sets of ``words``-word shingles
    differ in ``radius`` or fewer bits and the Jaccard similarity of the sets is ``similarity`` (a fraction)
    or more. Null, empty and blank texts have the same words, none; null ids come last; an empty table gives
    no rows. Covering masks find what is within the radius. First each print is compared with the nearest
    of each of its buckets; then with the nearest of every other component there, so that a group of near
    copies doesn't give all its pairs. Of rows with equal prints but other words
    each is compared with the first.
    """
    rows = numbered(docs)
    texts = rows.select("row", F.col(f"doc.`{text_col}`").cast("binary").alias("text"))
    found = saved(_named_prints(texts, words), "document-prints")
    names = saved(found.groupBy("name").agg(F.min("row").alias("node"), F.max("row").alias("last"), F.first("print").alias("print"), F.first("size").alias("size")), "document-names")
    more = names.where("node < last").select(F.col("name").alias("n"), "node")
    same = found.join(more, F.col("name") == F.col("n")).select(F.col("row").alias("a"), F.col("node").alias("b"))
    prints = saved(names.groupBy("print").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.min(F.struct("node", "size"))["size"].alias("size")), "distinct-prints")
    equal = names.select("node", apart(F.col("print")).alias("k")).join(prints.where("node < last").select(apart(F.col("print")).alias("k"), F.col("node").alias("first")), "k")
    nodes = lambda c: prints.select(F.col("print").alias(c), F.col("node").alias(f"{c}_node"))
    at = lambda pairs: pairs.join(nodes("a"), "a").join(nodes("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    near = saved(similar_prints(prints.select("print", F.col("node").alias("root"), "size"), radius, False), "print-pairs")
    links = _verified(at(near).unionByName(equal.select(F.col("node").alias("a"), F.col("first").alias("b"))), texts, words, similarity)
    met = near.select(F.explode(F.array("a", "b")).alias("print")).distinct()
    known = connected_components(links).select(apart(F.col("node")).alias("k"), "root")
    left = prints.join(met, "print", "left_semi").withColumn("k", apart(F.col("node"))).join(known, "k", "left")
    left = saved(left.select("print", F.coalesce("root", "node").alias("root"), "size"), "rooted-prints")
    more_pairs = similar_prints(left, radius, True).join(near, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(at(more_pairs), texts, words, similarity))

    roots = connected_components(links.unionByName(same)).select(apart(F.col("node")).alias("k"), "root")
    ids = rows.select("row", F.col(f"doc.`{id_col}`").cast("long").alias("id"), apart(F.col("row")).alias("k")).join(roots, "k", "left")
    first = (
        ids.groupBy(F.coalesce("root", "row").alias("group"))
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    return rows.join(first, "row", "left_semi").select("doc.*")
