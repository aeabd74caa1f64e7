"""Byte-level BPE by recursive DuckDB queries in each partition."""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed by the public pattern: white space as the Unicode property has it, and the classes within Latin-1.
LATIN_SPACE = r"\t-\r \x85\xa0"
SPACE = LATIN_SPACE + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LATIN_LETTER, LATIN_NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"

CHUNK_CHARS, CACHED_PIECES = 4_000_000, 300_000
#: A recursive step for each merge takes quadratic time in a piece; longer ones are merged with a heap.
LONG_PIECE = 1_024

#: One step contracts, in each word with a mergeable pair left, its leftmost pair of least rank. A row
#: is a token: its word, position, the next token's position and id. Words without a pair come out not live.
CONTRACT = """
WITH RECURSIVE t(w, pos, npos, id, nid, live) AS (
  SELECT w, pos, npos, id, nid, true FROM start_rows
  UNION ALL
  (WITH best AS (
     SELECT w, arg_min(pos, o) AS pos, arg_min(npos, o) AS npos, (min(o) >> 32)::INT AS m
     FROM (SELECT w, pos, npos, (m::BIGINT << 32) | pos AS o FROM t JOIN merges ON pair = id::BIGINT * 65536 + nid WHERE live)
     GROUP BY w
   ), edit AS (
     SELECT b.w, b.pos, b.npos, b.m, r.npos AS after, r.nid AS after_id FROM best b JOIN t r ON r.pos = b.npos
   )
   SELECT t.w, t.pos,
          CASE WHEN t.pos = e.pos THEN e.after ELSE t.npos END,
          CASE WHEN t.pos = e.pos THEN e.m ELSE t.id END,
          CASE WHEN t.pos = e.pos THEN e.after_id WHEN t.npos = e.pos THEN e.m ELSE t.nid END,
          e.w IS NOT NULL
   FROM t LEFT JOIN edit e USING (w) WHERE t.live AND (e.w IS NULL OR t.pos <> e.npos))
)
SELECT w, list(id ORDER BY pos) AS ids FROM t WHERE NOT live GROUP BY w ORDER BY w
"""

DECODE = "SELECT d, string_agg(s, '' ORDER BY pos) AS text FROM id_rows JOIN tokens USING (id) GROUP BY d"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def splitters(pattern: str) -> tuple:
    """(for texts within Latin-1, for any): functions from a text to its pieces.

    The two say the same as ``pattern``, with white space as a Unicode property; the first is
    written with plain ranges for the standard library's faster engine.
    """
    wide = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
    narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]")
    narrow = narrow.replace(r"\p{L}", f"[{LATIN_LETTER}]").replace(r"\p{N}", f"[{LATIN_NUMBER}]")
    narrow = narrow.replace(r"\s", f"[{LATIN_SPACE}]").replace(r"\S", f"[^{LATIN_SPACE}]")
    return (re.compile(narrow).findall if r"\p" not in narrow else wide.findall), wide.findall


class Codec:
    """Encodes and decodes with one vocabulary; holds a DuckDB connection, so one for each process."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.narrow, self.wide = splitters(pattern)
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        pair = np.array(left, dtype=np.int64) * 65536 + np.array(right, dtype=np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._table("merges", {"pair": pair, "m": np.array(merged, dtype=np.int32)})
        self._table("tokens", {"id": np.array(list(self.ranks.values()), dtype=np.int32), "s": [t.decode("latin-1") for t in self.ranks]})
        self.has = np.zeros(max(self.ranks.values()) + 1, dtype=bool)
        self.has[list(self.ranks.values())] = True
        self.known: dict[str, bytes] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, name: str, columns: dict, query: str) -> pa.Table:
        self.db.register(name, pa.table(columns))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return found

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as int32 arrays."""
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        at = [np.fromiter(map(number.__getitem__, self.pieces(t)), dtype=np.int64) for t in texts]
        codes = self._codes(list(number))
        size = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
        flat, start = np.frombuffer(b"".join(codes), dtype=np.int32), np.cumsum(size) - size
        out = []
        for p in at:
            n = size[p]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(start[p] - (ends - n), n) + np.arange(ends[-1])] if len(p) else flat[:0])
        return out

    def _codes(self, pieces: list[str]) -> list[bytes]:
        """The int32 ids of each piece, as bytes."""
        known = self.known
        todo = []
        for p in pieces:
            if p not in known:
                raw = p.encode()
                if (whole := self.ranks.get(raw)) is not None:
                    known[p] = whole.to_bytes(4, "little")
                elif len(raw) > LONG_PIECE:
                    known[p] = np.array(self.merged(raw), dtype=np.int32).tobytes()
                else:
                    todo.append((p, raw))
        if todo:
            size = np.fromiter((len(raw) for _, raw in todo), dtype=np.int64, count=len(todo))
            ids = self.first[np.frombuffer(b"".join(raw for _, raw in todo), dtype=np.uint8)]
            last = np.cumsum(size) - 1
            after, after_id = np.arange(1, len(ids) + 1, dtype=np.int32), np.append(ids[1:], np.int32(-1))
            after[last], after_id[last] = -1, -1
            rows = {"w": np.repeat(np.arange(len(todo), dtype=np.int32), size), "pos": np.arange(len(ids), dtype=np.int32), "npos": after, "id": ids, "nid": after_id}
            found = self._ask("start_rows", rows, CONTRACT).column("ids").combine_chunks()
            flat, cuts = found.values.to_numpy().astype(np.int32).tobytes(), found.offsets.to_numpy() * 4
            known.update((p, flat[a:b]) for (p, _), a, b in zip(todo, cuts.tolist(), cuts[1:].tolist()))
        codes = [known[p] for p in pieces]
        if len(known) > CACHED_PIECES:
            self.known = {}
        return codes

    def merged(self, raw: bytes) -> list[int]:
        """The ids of a long piece: the same merges, the next one taken from a heap."""
        ids, n = [bytes([b]) for b in raw], len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.ranks.get(ids[i] + ids[after[i]]) if after[i] < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] is not a or ids[j] is not b:
                continue
            ids[i], gone[j], after[i] = a + b, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [self.ranks[t] for t, x in zip(ids, gone) if not x]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids; an id that no token has is a ValueError."""
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        out = [b""] * len(ids)
        if size.sum():
            flat = np.concatenate(ids)
            if flat.min() < 0 or flat.max() >= len(self.has) or not self.has[flat].all():
                raise ValueError("an id is not in the vocabulary")
            rows = {"d": np.repeat(np.arange(len(ids), dtype=np.int32), size), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}
            found = self._ask("id_rows", rows, DECODE)
            for d, text in zip(found.column("d").to_pylist(), found.column("text").to_pylist()):
                out[d] = text.encode("latin-1")
        return out


_codecs: dict[tuple, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """This process's codec of the vocabulary."""
    key = (hash(raw), len(raw), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def batches_of(sizes: list[int], most: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of rows whose sizes sum to about ``most``, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield slice(start, len(sizes))


def _run(df: DataFrame, spark: SparkSession, path: str, pattern: str, keep: list[str], given: str, made: str, work) -> DataFrame:
    """``df`` batch by batch through ``work(codec, values) -> columns``; the columns ``keep`` go along."""
    with open(path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size
    schema = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            n = np.diff(values.offsets.to_numpy()) if pa.types.is_list(values.type) else [len(x.as_buffer()) if x.is_valid else 0 for x in values]
            for part in batches_of(list(n)):
                rows = batch.slice(part.start, part.stop - part.start)
                columns = work(codec(raw.value, pattern), rows.column(rows.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *columns.values()], [*keep, *columns])

    return df.select(*[F.col(f"`{c}`") for c in keep], given).mapInArrow(run, schema)


def _texts(column: pa.Array) -> list[str]:
    return [(x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "") for x in column]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    size = np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``ids`` array<int>: the whole text's tokens, as tiktoken's encode_ordinary has them.

    Null text counts as empty (no ids); bytes that aren't UTF-8 count as U+FFFD. Rows stay in
    their partitions: each batch's distinct pieces are start rows of one recursive DuckDB query.
    """
    work = lambda c, column: {"ids": _lists(c.encode(_texts(column)))}
    return _run(docs, docs.sparkSession, path, pattern, keep, F.col(f"`{text_col}`").cast("binary"), "ids array<int>", work)


def decode(df: DataFrame, path: str, pattern: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded`` binary: the bytes of ``ids_col``; null ids count as none."""
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    work = lambda c, column: {"decoded": pa.array(c.decode([x.values.to_numpy() for x in column]), pa.binary())}
    return _run(df, df.sparkSession, path, pattern, keep, ids, "decoded binary", work)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``ids`` and ``decoded``: ``encode`` and ``decode`` in one Python worker."""

    def work(c: Codec, column: pa.Array) -> dict:
        ids = c.encode(_texts(column))
        return {"ids": _lists(ids), "decoded": pa.array(c.decode(ids), pa.binary())}

    return _run(docs, docs.sparkSession, path, pattern, keep, F.col(f"`{text_col}`").cast("binary"), "ids array<int>, decoded binary", work)
