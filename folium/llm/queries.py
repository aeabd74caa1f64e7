"""Queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import bpe, embedding_dedup, exact_dedup, line_dedup, mixing, simhash, substring_dedup, token_counts, toxicity, warc

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_documents(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severities(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, ["doc_id"])
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_archives(spark, table(spark, sf_dir, "pages")).drop("ok")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a note put in and some characters taken out, at places that follow from its id."""
    docs = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    place = lambda k: F.pmod(F.coalesce("doc_id", F.lit(0)) * k, size + 1).cast("int")
    edit = lambda at, n, text: F.struct(at.alias("at"), F.lit(n).alias("n_deleted"), F.lit(text).alias("inserted"))
    edits = F.array(edit(place(7919), 0, " (note 1: revised)\n"), edit(place(104729), 24, ""))
    found = token_counts.edited_counts(docs, VOCABULARY, PATTERN, edits)
    return found.withColumn("n_leaves", F.size("leaf_tokens").cast("long")).drop("leaf_chars", "leaf_tokens")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_near_lines(table(spark, sf_dir, "documents"), shortest=1)
    kept = F.coalesce("text", F.lit(""))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_suffix_array": op8_suffix_array,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BASE32_SHA1 = """list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_sum(list_transform(range(5), lambda b: ((strpos('0123456789abcdef', substr(sha, (i * 5 + b) // 4 + 1, 1)) - 1)
        >> (3 - (i * 5 + b) % 4)::INT & 1) << (4 - b)::INT))::INT + 1, 1)), 'string_agg', '')"""

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        ), usable AS (
            SELECT * FROM vectors WHERE label IS NOT NULL AND len(list_filter(e, lambda x: isfinite(x))) = len(e) AND list_max(list_transform(e, lambda x: abs(x))) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(node, root) AS (
            SELECT vec_id, vec_id FROM vectors UNION SELECT b, root FROM reach JOIN links ON node = a
        )
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM (SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY node) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
    """,
    "op5_warc": f"""
        SELECT page_id, payload_bytes, {_BASE32_SHA1} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS sha,
                     min(page_id) OVER (PARTITION BY body) AS first
              FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
    """,
    "op7_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
        WINDOW w AS (PARTITION BY norm)
    """,
    "op8_suffix_array": """
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), strings AS (
            SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS pos FROM docs)
        ), found AS (
            SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY s) AS least FROM strings) WHERE least < doc_id
        ), marked AS (
            SELECT doc_id, pos, coalesce((pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50)::INT, 0) AS new FROM found
        ), runs AS (
            SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked) GROUP BY doc_id, run
        ), between_runs AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM runs
        ), cut AS (
            SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS z, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front
            FROM between_runs JOIN docs USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
        FROM docs LEFT JOIN cut USING (doc_id)
    """,
    "op10_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   coalesce('+' || source, '-') AS key
            FROM documents
        ), placed AS (
            SELECT *, floor(log2(size + 1.0) * 6.0)::INT AS class,
                   coalesce((doc_id % n + n) % n, 0) AS slice
            FROM sized, (SELECT greatest(1, ceil(count(*) / 50000.0))::BIGINT AS n FROM documents)
        ), sources AS (
            SELECT key, source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn
            FROM sized GROUP BY key, source
        ), ranked AS (
            SELECT *, source_size * 2.0::DOUBLE AS cap, [3, 1, 2][turn % 3 + 1]::DOUBLE AS weight,
                   1.5::DOUBLE * sum(source_size) OVER () AS budget, cap / weight AS full_at
            FROM sources
        ), levels AS (
            SELECT *, (budget - coalesce(sum(cap) OVER before, 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level_here
            FROM ranked
            WINDOW before AS (ORDER BY full_at, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), targets AS (
            SELECT key, source_size,
                   least(cap, coalesce((SELECT arg_min(level_here, (full_at, turn)) FROM levels WHERE level_here <= full_at) * weight, cap)) AS target,
                   ('0x' || substr(md5('42|' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
            FROM levels
        ), numbered AS (
            SELECT doc_id, size, source_size, target, shift,
                   CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   row_number() OVER (PARTITION BY key ORDER BY class, slice, size, doc_id NULLS FIRST) AS nth
            FROM placed JOIN targets USING (key)
        )
        SELECT doc_id, size, source_size, target,
               ((floor(shift + nth * rate) - floor(shift + (nth - 1) * rate))::BIGINT * size) AS taken
        FROM numbered
    """,
}
