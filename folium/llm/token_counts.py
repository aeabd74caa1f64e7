"""Token counts that follow edits: a segment tree over each document's pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.bpe import read_ranks, splitters

#: Pre-tokens in a leaf; a leaf that grows to SPLIT times that many is divided.
LEAF, SPLIT, CACHED = 64, 4, 500_000
#: Characters after a pre-token that its match can depend on: the next one, and one more after white space.
AHEAD = 2


class Counter:
    """Tokens of each pre-token, with one vocabulary; one for each process."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = read_ranks(raw)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.narrow, self.wide = splitters(pattern)
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def counts(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))


class Tree:
    """Characters and tokens of consecutive leaves, with the sums of each subtree.

    ``sums`` is a heap: node k has children 2k and 2k + 1, leaf i is node ``width`` + i; the two
    columns are characters and tokens.
    """

    def __init__(self, leaves: np.ndarray):
        self.leaves = len(leaves)
        self.width = 1 << max(0, self.leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width : self.width + self.leaves] = leaves
        level = self.width
        while level > 1:
            level //= 2
            self.sums[level : 2 * level] = self.sums[2 * level : 4 * level : 2] + self.sums[2 * level + 1 : 4 * level : 2]

    @property
    def total(self) -> tuple[int, int]:
        return tuple(self.sums[1].tolist())

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``; the last leaf for the end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, value: np.ndarray) -> None:
        """Sets a leaf; each sum above it changes by the difference."""
        node = self.width + leaf
        change = value - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def rows(self) -> np.ndarray:
        return self.sums[self.width : self.width + self.leaves]


def leaves_of(pieces: list[str], counter: Counter, leaf: int = LEAF) -> np.ndarray:
    if not pieces:
        return np.zeros((0, 2), dtype=np.int64)
    both = np.stack([np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)), counter.counts(pieces)], axis=1)
    return np.add.reduceat(both, np.arange(0, len(pieces), leaf), axis=0)


@dataclass
class Counted:
    """A document's text and tree, and the characters that were encoded to keep the tree right."""

    text: str
    tree: Tree
    encoded: int = 0

    @classmethod
    def of(cls, text: str, counter: Counter) -> Counted:
        return cls(text, Tree(leaves_of(counter.pieces(text), counter)), 0)

    def edit(self, at: int, n_deleted: int, inserted: str, counter: Counter) -> None:
        """Replaces ``n_deleted`` characters at ``at``; both are brought into the text's bounds.

        Matching of pre-tokens depends only on what follows their start, so those that end AHEAD
        characters before the edit stay; from there the text is cut again until a cut meets the
        first character of an old leaf behind the edit, after which all old cuts hold.
        """
        size = len(self.text)
        at = min(max(at, 0), size)
        end = min(at + max(n_deleted, 0), size)
        text = self.text[:at] + inserted + self.text[end:]
        shift = len(text) - size
        tree = self.tree
        if not tree.leaves:
            self.text, self.tree, self.encoded = text, Tree(leaves_of(counter.pieces(text), counter)), self.encoded + len(text)
            return
        first, begin = tree.find(max(0, at - AHEAD))
        if begin > at - AHEAD and first:  # its start is known only from what the edit changed
            first, begin = tree.find(begin - 1)
        stop, ahead = tree.find(end)
        ahead += int(tree.rows()[stop, 0])
        stop += 1
        while True:
            limit = len(text) if stop >= tree.leaves else ahead + shift
            reach = limit if limit == len(text) else limit + int(tree.rows()[stop, 0])
            pieces = counter.pieces(text[begin:reach])
            ends = begin + np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
            met = np.flatnonzero(ends == limit) if limit > begin else np.array([-1])
            if limit == len(text) or len(met) and reach - limit > AHEAD:
                break
            ahead += int(tree.rows()[stop, 0])
            stop += 1
        cut = len(pieces) if limit == len(text) else int(met[0]) + 1
        self.text, self.encoded = text, self.encoded + limit - begin
        self._put(first, stop, pieces[:cut], counter)

    def _put(self, first: int, stop: int, pieces: list[str], counter: Counter) -> None:
        n = stop - first
        if pieces and n * LEAF // SPLIT <= len(pieces) <= n * LEAF * SPLIT and len(pieces) >= n:
            for i, part in enumerate(np.array_split(np.arange(len(pieces)), n)):
                self.tree.put(first + i, leaves_of([pieces[k] for k in part], counter, len(part))[0])
        else:
            rows = self.tree.rows()
            self.tree = Tree(np.concatenate([rows[:first], leaves_of(pieces, counter), rows[stop:]]))


_counters: dict[tuple, Counter] = {}


def counter_of(raw: bytes, pattern: str) -> Counter:
    key = (hash(raw), len(raw), pattern)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(raw, pattern)
    return _counters[key]


EDITS = "array<struct<at:int,n_deleted:int,inserted:string>>"


def edited_counts(docs: DataFrame, path: str, pattern: str, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_encoded, leaf_chars, leaf_tokens) for each row.

    ``edits`` is an array of (at, n_deleted, inserted), applied to the whole text in order; null
    is none, null fields are 0, 0 and ''. Positions beyond the text mean its end. Both counts are
    what a full encoding gives; ``n_chars_encoded`` is what the edits made necessary. The leaves
    are the tree after the edits. Null text is empty; rows stay in their partitions.
    """
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_chars_edited", pa.int64()), ("n_chars_encoded", pa.int64()), ("leaf_chars", pa.list_(pa.int64())), ("leaf_tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter, rows = counter_of(raw.value, pattern), []
            for key, text, changes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                doc = Counted.of(text.as_buffer().to_pybytes().decode("utf-8", "replace") if text.is_valid else "", counter)
                before = doc.tree.total[1]
                for e in changes or []:
                    if e is not None:
                        doc.edit(e["at"] or 0, e["n_deleted"] or 0, e["inserted"] or "", counter)
                chars, tokens = doc.tree.total
                rows.append((key, before, tokens, chars, doc.encoded, *doc.tree.rows().T.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(out), out.types)], schema=out)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), edits.cast(EDITS).alias("edits"))
    ddl = "id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long, leaf_chars array<long>, leaf_tokens array<long>"
    return given.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
