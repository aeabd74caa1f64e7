"""WARC archives: writing segmented, chunk-framed records and reassembling them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import new_path, saved

#: Fixed by the WARC and HTTP formats.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 16_384, 4_096, 20_000
ROWS_PER_BATCH = 256
#: Archives up to this size are read as one value, longer ones as a stream.
WHOLE_BYTES = 256_000_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked transfer; extensions and trailers are skipped, a broken frame is a ValueError."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line is cut off")
        n = int(framed[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = line + 2
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(framed[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else body


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    safe = lambda v: v.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if re.search(r"[\r\n]", v) else v
    head = [f"{k}: {safe(v)}" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None]
    return b"\r\n".join([VERSION, *(x.encode() for x in head)]) + END + block


def page_records(page_id, url, payload: bytes, digest: str, first, segment_bytes: int) -> list[bytes]:
    """The record of a page: a response, in segments if it is long, or a revisit of page ``first``."""
    own, head = f"<urn:page:{page_id}:{digest}>", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = ("Content-Type", "application/http; msgtype=response")
    if first is not None and first != page_id:
        refers = [("WARC-Refers-To", f"<urn:page:{first}:{digest}>"), ("WARC-Profile", REVISIT_PROFILE)]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *refers, http], head + b"\r\n")]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    number = lambda k: [("WARC-Segment-Number", str(k))] if len(parts) > 1 else []
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *number(1), http], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), *number(k), *total], part))
    return out


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Writes gzip archives under ``path``: a record per row, revisits for all but the first of equal payloads.

    The smallest id of equal payloads of at least ``least_bytes`` bytes is the response; a null
    body counts as empty; rows that share that id and payload are all responses; a row with a null
    id is a revisit if another row has its payload and an id. Spark's text writer does the writing,
    so any store that Spark writes to will do.
    """
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "xx": F.xxhash64("payload")})
    firsts = saved(
        keyed.where(F.octet_length("payload") >= least_bytes).groupBy("sha", "xx").agg(F.min("page_id").alias("first")), "firsts"
    )
    rows = keyed.join(firsts, ["sha", "xx"], "left").select("page_id", "url", "payload", "first")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                out = []
                for r in batch.slice(at, ROWS_PER_BATCH).to_pylist():
                    out += page_records(r["page_id"], r["url"], r["payload"], base32_sha1(r["payload"]), r["first"], segment_bytes)
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    records = rows.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; lengths alone tell where a record ends."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        if not (length := fields.get("content-length", "")).isdecimal():
            raise ValueError(f"record without a length: {length!r}")
        if len(block := stream.read(int(length))) != int(length):
            raise ValueError("record is cut off")
        yield fields, block


class Fragments(io.RawIOBase):
    """A file that Spark's text reader cut at ``END``, as a stream; one fragment is held at a time."""

    def __init__(self, parts: Iterable[bytes]):
        self.parts, self.now = iter(parts), None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.now:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.now = memoryview(part if self.now is None else END + part)
        n = min(len(into), len(self.now))
        into[:n], self.now = self.now[:n], self.now[n:]
        return n


_DONE = "payload_bytes long, payload_digest string, payload binary, ok boolean"
_HEAD = "origin string, page_id string, record_type string, refers_to string, digest string"


def _decoded(block: bytes, keep: bool) -> dict:
    try:
        payload = http_payload(block)
    except ValueError:
        return {"payload_bytes": None, "payload_digest": None, "payload": None, "ok": False}
    return {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "payload": payload if keep else None, "ok": True}


def rows_of(stream: io.BufferedIOBase, keep: bool) -> Iterator[dict]:
    """A row for each response, revisit and continuation; one with ok false where the stream can't be read on."""
    try:
        for fields, block in records_of(stream):
            kind, own = fields.get("warc-type"), fields.get("warc-record-id")
            if kind not in ("response", "revisit", "continuation"):
                continue
            segment, total = fields.get("warc-segment-number", "0"), fields.get("warc-segment-total-length", "0")
            row = {
                "origin": fields.get("warc-segment-origin-id", own), "page_id": _page(own), "record_type": kind,
                "refers_to": fields.get("warc-refers-to"), "digest": fields.get("warc-payload-digest"),
            }
            if row["origin"] is None or not segment.isdecimal() or not total.isdecimal() or kind == "continuation" and not int(segment):
                yield row | {"segment": 0, "ok": False}
            elif int(segment):
                yield row | {"segment": int(segment), "total": int(total) or None, "block": block}
            else:
                yield row | {"segment": 0} | (_decoded(block, keep) if kind == "response" else {"ok": True})
    except (ValueError, EOFError, OSError, zlib.error):
        yield {"segment": 0, "ok": False}


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """The records of the archives under ``path``, segments joined and transfer framing decoded.

    (origin, page_id, record_type, refers_to, digest, payload_bytes, payload_digest, payload, ok).
    Continuations are grouped by the origin record's identifier, ordered by segment number and
    held against the total length in the last; ok is false, and the payload null, where segments
    are missing, the length differs or a frame is broken. Records that have all their block are
    decoded where they are read, so only segments are moved; segments that equal each other are
    summed first, so repeated records meet as one with a count. Revisits have no payload (null).

    A record without an identifier, or with no number as segment or total, is a row with ok false.
    Where an archive is cut off or a record's length can't be told, one row with ok false and nulls
    else stands for the rest of that archive; other archives go on. No archives, no rows.

    Archives of over ``whole_bytes`` bytes, which must be named ``.gz``, are read as a stream of
    any length through Spark's text reader, which ends the job where their compression is broken.
    """
    files = spark.read.format("binaryFile").load(path)
    large = [r.path for r in files.where(F.col("length") > whole_bytes).select("path").collect()]  # names only
    if unsplit := [x for x in large if not x.endswith(".gz")]:
        raise ValueError(f"compress archives of over {whole_bytes} bytes: {unsplit[:3]}")
    ddl = f"{_HEAD}, segment int, total long, block binary, {_DONE}"

    def batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        while part := list(itertools.islice(rows, ROWS_PER_BATCH)):
            yield pa.RecordBatch.from_pylist(part, schema=_arrow(ddl))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(memoryview(content.as_buffer()))
                stream = gzip.open(raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                yield from batched(rows_of(io.BufferedReader(stream), keep_payload))

    def parse_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for _, part in itertools.groupby(lines, key=lambda pair: pair[0]):
            yield from batched(rows_of(io.BufferedReader(Fragments(value for _, value in part)), keep_payload))

    parsed = files.where(F.col("length") <= whole_bytes).select("content").mapInArrow(parse, ddl)
    if large:
        lines = spark.read.option("lineSep", END.decode()).text(large)
        lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
        parsed = parsed.unionByName(lines.mapInArrow(parse_stream, ddl))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(f"{_HEAD}, {_DONE}, n long")
        for batch in batches:
            for group in batch.column("found").to_pylist():
                parts = {r["part"]["segment"]: r["part"] for r in group}
                times = next((r["n"] for r in group if r["part"]["segment"] == 1), 1)
                yield pa.RecordBatch.from_pylist([joined(parts, keep_payload) | {"n": times}], schema=schema)

    whole = parsed.where("segment = 0").drop("segment", "total", "block")
    own = F.struct("origin", "segment", "total", "page_id", "refers_to", "digest", "block")
    parts = parsed.where("segment > 0").groupBy("origin", "segment").agg(F.min(own).alias("part"), F.count("*").alias("n"))
    found = parts.groupBy("origin").agg(F.collect_list(F.struct("part", "n")).alias("found")).select("found")
    repeated = found.mapInArrow(join, f"{_HEAD}, {_DONE}, n long").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return whole.unionByName(repeated.drop("n", "again"))


def joined(parts: dict[int, dict], keep: bool) -> dict:
    """The record whose segments are ``parts``, by number."""
    last, first = parts[max(parts)], parts.get(1)
    whole = sorted(parts) == list(range(1, len(parts) + 1)) and last["total"] is not None
    block = b"".join(parts[k]["block"] for k in sorted(parts))
    if not whole or len(block) != last["total"]:
        done = {"payload_bytes": None, "payload_digest": None, "payload": None, "ok": False}
    else:
        done = _decoded(block, keep)
    return {k: (first or last)[k] for k in ("origin", "page_id", "refers_to", "digest")} | {"record_type": "response"} | done


def _page(record_id: str | None) -> str | None:
    m = re.match(r"<urn:page:(-?\d+):", record_id or "")
    return m[1] if m else None


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def page_archives(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, ok) for each row; a revisit
    takes length and digest from the response that it names. No pages, no rows.
    """
    write_archives(pages, path := new_path(spark, "warc"), **options)
    read = saved(read_archives(spark, path, keep_payload=False).drop("payload"), "records")
    responses = read.where("record_type = 'response'").select(
        F.col("origin").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")
    )
    target = F.regexp_extract("refers_to", r"<urn:page:(-?\d+):", 1)
    revisits = read.where("record_type = 'revisit'").join(responses.dropDuplicates(["refers_to"]).withColumn("refers_to", F.concat("refers_to", F.lit(""))), "refers_to", "left")
    page = F.col("page_id").cast("long").alias("page_id")
    return (
        read.where("record_type = 'response'")
        .select(page, "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "ok")
        .unionByName(
            revisits.select(page, F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", target.cast("long").alias("refers_to"), F.col("n").isNotNull().alias("ok"))
        )
    )
