"""Removal of long repeated byte strings, by suffix arrays over shards of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import saved

LENGTH = 50
#: Bytes of an anchor; of any LENGTH - GRAM + 1 neighbouring places one is chosen as anchor.
GRAM = 12
#: Text that a step holds at once, item bytes meant for a shard, and the share (1 in HEAVY) that makes an anchor heavy.
BATCH_BYTES, SHARD_BYTES, HEAVY = 4_000_000, 4_000_000, 4_096
#: Merged spans that may be broadcast: 16 bytes each and 64 a document.
BROADCAST_BYTES = 64_000_000
LAST = 2**63 - 1


# --- suffix arrays ---------------------------------------------------------------------------


def types_of(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the one that starts a place later. The last is S-type."""
    n = len(t)
    step = np.ones(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, top: int) -> np.ndarray:
    """The suffix order that sorted ``seeds`` (leftmost S-type places) induce, one symbol's bucket at a time.

    Going up, a bucket's L-type suffixes are those that lower buckets, or the bucket itself, put
    there; going down likewise for S-type ones. A bucket's part is one array operation for each
    turn that stays in the bucket, so a turn for each repeat of a symbol.
    """
    none = np.empty(0, dtype=np.int64)
    low: list[list] = [[] for _ in range(top + 1)]
    start = np.searchsorted(t[seeds], np.arange(top + 2), side="left") if len(seeds) else np.zeros(top + 2, dtype=np.int64)

    def deal(found: list[np.ndarray], into: list[list]) -> None:
        before = np.concatenate(found)
        if not len(before):
            return
        symbols = t[before].astype(np.uint16 if top < 1 << 16 else np.int64)  # 16 bits are sorted by radix
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(before)]):
            into[int(symbols[a])].append(before[a:b])

    done_low = []
    for c in range(top + 1):
        turn, out = (np.concatenate(low[c]) if low[c] else none), []
        whole = []
        while len(turn):
            whole.append(turn)
            before = turn[turn > 0] - 1
            before = before[~s_type[before]]
            same = t[before] == c
            out.append(before[~same])
            turn = before[same]
        done_low.append(np.concatenate(whole) if whole else none)
        own = seeds[start[c] : start[c + 1]]
        before = own[own > 0] - 1
        out.append(before[~s_type[before]])
        deal(out, low)
    high: list[list] = [[] for _ in range(top + 1)]
    parts = []
    for c in range(top, -1, -1):
        turn, out, whole = (np.concatenate(high[c]) if high[c] else none), [], []
        while len(turn):
            whole.append(turn)
            before = turn[turn > 0] - 1
            before = before[s_type[before]]
            same = t[before] == c
            out.append(before[~same])
            turn = before[same]
        if c == t[-1]:  # the last place has no successor to put it here; it is its bucket's least
            whole.append(np.array([len(t) - 1]))
        back = done_low[c][::-1]
        before = back[back > 0] - 1
        out.append(before[s_type[before]])
        deal(out, high)
        parts.append(np.concatenate([*whole, back]) if whole else back)
    return np.concatenate(parts)[::-1]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``t`` by their suffixes' first ``depth`` symbols at least.

    ``t`` ends with its only, or its least, 0. Leftmost S-type substrings are sorted by induction
    and named; where names repeat, the string of names is sorted in turn, by this function while
    its alphabet is small and by doubling ranks where almost every symbol has a bucket to itself.
    """
    s_type = types_of(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    top = int(t.max())
    if len(lms) < 2:
        return induce(t, s_type, lms, top)
    first = induce(t, s_type, lms[np.argsort(t[lms], kind="stable")], top)
    is_lms = np.zeros(len(t), dtype=bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    end = np.full(len(t), len(t))
    end[lms[:-1]] = lms[1:] + 1
    a, b = order[:-1], order[1:]
    equal = (end[a] - a == end[b] - b) & (t[a] == t[b])
    live, at = np.flatnonzero(equal), 1
    while len(live):
        x, y = a[live], b[live]
        more = x + at < end[x]
        live, x, y = live[more], x[more], y[more]
        same = t[np.minimum(x + at, len(t) - 1)] == t[np.minimum(y + at, len(t) - 1)]
        equal[live[~same]] = False
        live, at = live[same], at + 1
    name = np.zeros(len(t), dtype=np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~equal)])
    names = name[lms]
    most = int(names.max()) + 1
    if most == len(lms):
        seeds = order
    elif most <= 256:
        sub = suffix_array(np.append(names + 1, 0).astype(np.int64), depth)
        seeds = lms[sub[sub < len(lms)]]
    else:
        seeds = lms[doubled(names, depth // 2 + 1)]
    return induce(t, s_type, seeds, top)


def doubled(rank: np.ndarray, depth: int) -> np.ndarray:
    """Places by their first ``depth`` symbols, ranks doubling in reach."""
    n, reach = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while reach < depth:
        after = np.zeros(n, dtype=np.int64)
        after[:-reach] = rank[reach:] + 1
        key = rank * np.int64(n + 2) + after
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1 or reach >= n:
            break
        reach *= 2
    return order


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number; zeros beyond the end."""
    w = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w[:-step] |= w[step:] << np.uint64(8 * step)
    return w[: len(data)]


def common_prefixes(data: np.ndarray, order: np.ndarray, usable: np.ndarray, depth: int) -> np.ndarray:
    """By place: whether its first ``depth`` bytes equal those of the place before it in ``order``.

    The permuted form: each place's predecessor in suffix order is looked up in text order. Both
    must have ``depth`` bytes in their item (``usable``).
    """
    before = np.full(len(order), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(usable & (before >= 0))
    at = at[usable[before[at]]]
    w = words(data)
    for k in [*range(0, depth - 7, 8), depth - 8]:
        at = at[w[at + k] == w[before[at] + k]]
    out = np.zeros(len(order), dtype=bool)
    out[at] = True
    return out


# --- anchors and items ------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    w = words(data)
    rest = np.concatenate([w[8:], np.zeros(8, dtype=np.uint64)]) & np.uint64((1 << 8 * (GRAM - 8)) - 1)
    h = w[: len(data)] * np.uint64(0x9E3779B97F4A7C15) ^ rest[: len(data)] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def anchored(texts: list[bytes], heavy: np.ndarray, length: int) -> tuple:
    """(data, first place, places, anchor's place, anchor's hash, text) of each run of windows that share an anchor.

    A window is ``length`` bytes in one text. Its anchor is the leftmost of its grams of least
    hash, heavy ones coming last; the choice depends on the window's bytes alone, so equal windows
    have equal anchors at equal offsets.
    """
    reach = length - GRAM + 1
    out = []
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    stop = np.cumsum(size)
    flags = np.zeros(1 << 16, dtype=bool)
    flags[(heavy & np.uint64(0xFFFF)).astype(np.int64)] = True
    bits = np.uint64(20)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + (1 << 18), side="right")))
        begin = int(stop[i - 1]) if i else 0
        for a in range(begin, int(stop[j - 1]), 1 << 19):  # a text of its own may be long: pieces that overlap by a window
            b = min(int(stop[j - 1]), a + (1 << 19) + length - 1)
            out.append(_anchored(data[a:b], a, stop[i:j], heavy, flags, bits, reach, length, (1 << 19)))
        i = j
    out.append([np.empty(0, dtype=np.int64)] * 3 + [np.empty(0, dtype=np.uint64)])
    first, count, anchor, h = (np.concatenate(x) for x in zip(*out))
    return data, first, count, anchor, h, np.searchsorted(stop, first, side="right")


def _anchored(data, base, stop, heavy, flags, bits, reach, length, most):
    n = len(data)
    h = gram_hashes(data)
    value = h >> np.uint64(1)
    maybe = np.flatnonzero(flags[(h & np.uint64(0xFFFF)).astype(np.int64)])
    if len(maybe):
        value[maybe[np.isin(h[maybe], heavy)]] |= np.uint64(1 << 63)
    value = value >> bits << bits | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        value[:-width] = np.minimum(value[:-width], value[width:])
        width *= 2
    if reach > width:
        value[: -(reach - width)] = np.minimum(value[: -(reach - width)], value[reach - width :])
    place = np.arange(base, base + n)
    room = stop[np.minimum(np.searchsorted(stop, place, side="right"), len(stop) - 1)] - place
    at = np.flatnonzero((room >= length) & (np.arange(n) < most) & (np.arange(n) + length <= n))
    if not len(at):
        return [np.empty(0, dtype=np.int64)] * 3 + [np.empty(0, dtype=np.uint64)]
    anchor = (value[at] & np.uint64((1 << 20) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    return at[new] + base, np.diff(np.append(new, len(at))), anchor[new] + base, h[anchor[new]]


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns as one compressed value: a count, then each column's bytes."""
    raw = [len(columns[0]).to_bytes(8, "little")] + [np.ascontiguousarray(c).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


#: Columns of an item: document, tag, start, windows, anchor's offset; then the items' bytes.
ITEM = [("<i8",), ("<i8",), ("<i4",), ("u1",), ("u1",)]
SPAN = [("<i8",), ("<i8",), ("<i4",), ("<i4",)]


def unpack(blob: bytes, kinds: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n, at, out = int(raw[:8].view("<i8")[0]), 8, []
    for (kind,) in kinds:
        step = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw[at : at + step].tobytes(), dtype=kind))
        at += step
    return out, raw[at:]


def items_of(docs: list[tuple[int, int, bytes]], heavy: np.ndarray, shards: int, length: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(shard, packed items, packed spans) of some documents (id, tag, text).

    Of equal items only those of the least id are sent: the others' windows are found in it, so
    they are spans to remove already. That sums up groups of copies before the shuffle.
    """
    data, first, count, anchor, h, text = anchored([d[2] for d in docs], heavy, length)
    raw, size = data.tobytes(), (count + (length - 1)).tolist()
    key = np.array([d[0] for d in docs], dtype=np.int64)
    tag = np.array([d[1] for d in docs], dtype=np.int64)
    start_of = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])])
    contexts = [raw[a : a + n] for a, n in zip(first.tolist(), size)]
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(c, len(number)) for c in contexts), dtype=np.int64, count=len(contexts))
    least = np.full(len(number), LAST, dtype=np.int64)
    np.minimum.at(least, which, key[text])
    sent = key[text] == least[which]
    start = first - start_of[text]
    gone = np.flatnonzero(~sent)
    spans = pack([key[text[gone]], tag[text[gone]], start[gone].astype("<i4"), (start[gone] + count[gone] + length - 1).astype("<i4")]) if len(gone) else None
    rows = np.flatnonzero(sent)
    shard = ((h[rows] >> np.uint64(11)) % np.uint64(shards)).astype(np.int64)
    rows = rows[np.argsort(shard, kind="stable")]
    shard = np.sort(shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist() if len(rows) else []
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        r = rows[a:b]
        columns = [key[text[r]], tag[text[r]], start[r].astype("<i4"), count[r].astype("u1"), (anchor[r] - first[r]).astype("u1")]
        blob = pack([*columns, np.frombuffer(b"".join([contexts[i] for i in r.tolist()]), dtype=np.uint8)])
        yield int(shard[a]), blob, spans
        spans = None
    if spans is not None:
        yield int(docs[0][0]) % shards, None, spans


def may_match(w: np.ndarray, begin: np.ndarray, size: np.ndarray, gram: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Whether an item shares enough around its anchor with one of another document to have a window in common.

    A window reaches at least half of what it has besides the anchor to one side of it, so two that
    match have the anchor and that many bytes behind it in common, or before it.
    """
    side = (length - GRAM) // 2
    found = np.zeros(len(key), dtype=bool)
    for first in (gram, gram - side):
        has = np.flatnonzero((first >= begin) & (first + side + GRAM <= begin + size))
        if len(has):
            h = np.zeros(len(has), dtype=np.uint64)
            for k in [*range(0, side + GRAM - 7, 8), side + GRAM - 8]:
                h = (h ^ w[first[has] + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            order = np.argsort(h)
            cuts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            keys = key[has[order]]
            many = np.minimum.reduceat(keys, cuts) < np.maximum.reduceat(keys, cuts)
            found[has[order]] |= np.repeat(many, np.diff(np.append(cuts, len(order))))
    return found


def solve(blobs: list[bytes], length: int) -> list[np.ndarray]:
    """Spans (document, tag, from, to) of a shard's items: windows that a smaller document has too."""
    given = [unpack(b, ITEM) for b in blobs]
    none = [np.empty(0, dtype=k) for (k,) in SPAN]
    if not given:
        return none
    key, tag, start, count, offset = (np.concatenate([g[0][i] for g in given]) for i in range(5))
    data = np.concatenate([g[1] for g in given])
    count = count.astype(np.int64)
    size = count + (length - 1)
    begin = np.cumsum(size) - size
    kept = np.flatnonzero(may_match(words(data), begin, size, begin + offset, key, length))
    if not len(kept):
        return none
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(raw[s : s + n], len(number)) for s, n in zip(begin[kept].tolist(), size[kept].tolist())), dtype=np.int64, count=len(kept))
    own = np.full(len(number), LAST)
    np.minimum.at(own, which, key[kept])
    long = np.fromiter(map(len, number), dtype=np.int64, count=len(number))
    joined = np.frombuffer(b"\0".join(number) + b"\0", dtype=np.uint8)
    stop = np.cumsum(long + 1) - 1
    t = joined.astype(np.int64) + 1
    t[stop] = 0
    order = suffix_array(t, length)
    place = np.arange(len(joined))
    item = np.searchsorted(stop, place, side="left")
    usable = stop[item] - place >= length
    alike = common_prefixes(joined, order, usable, length)
    bounds = np.flatnonzero(~alike[order])
    least = np.minimum.reduceat(own[item[order]], bounds)
    found = np.empty(len(order), dtype=np.int64)
    found[order] = np.repeat(least, np.diff(np.append(bounds, len(order))))
    n = count[kept]
    base = (stop - long)[which]
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(kept)), n)
    step = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
    hit = found[base[row] + step] < key[kept][row]
    edge = np.diff(np.concatenate([[0], (hit & (step >= 0)).astype(np.int8)]))
    new = hit & ((edge == 1) | (step == 0))
    final = hit & (np.append(~hit[1:], True) | (step == n[row] - 1))
    i, j = np.flatnonzero(new), np.flatnonzero(final)
    r = kept[row[i]]
    return [key[r], tag[r], (start[r] + step[i]).astype("<i4"), (start[r] + step[j] + length).astype("<i4")]


# --- the operator -----------------------------------------------------------------------------


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    docs, size = [], 0
    for batch in batches:
        for key, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            docs.append((key, tag, text.as_buffer().to_pybytes()))
            size += len(docs[-1][2])
            if size >= BATCH_BYTES:
                yield docs
                docs, size = [], 0
    if docs:
        yield docs


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, tag, spans array<struct<lo,hi>>) of rows (key, tag, text binary): maximal spans to remove, in order."""
    if not GRAM < length < 256:
        raise ValueError(f"the length must be between {GRAM + 1} and 255")
    nothing = np.empty(0, dtype=np.uint64)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _batches(batches):
            h = anchored([d[2] for d in some], nothing, length)[4]
            names, times = np.unique(h.view(np.int64), return_counts=True)
            often = times * HEAVY >= len(h)
            yield pa.RecordBatch.from_pydict({"h": np.append(names[often], 0), "n": np.append(times[often], len(h)), "whole": np.append(np.zeros(int(often.sum()), dtype=bool), True)})

    counted = saved(docs.mapInArrow(common, "h long, n long, whole boolean").groupBy("whole", "h").agg(F.sum("n").alias("n")), "anchors")
    total = counted.where("whole").agg(F.sum("n")).first()[0] or 0
    # sums of what is a share of some batch: at most HEAVY of them reach that share of all
    heavy = [r.h for r in counted.where(f"not whole and n * {HEAVY} >= {total}").select("h").limit(HEAVY + 1).collect()]
    heavy = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(heavy, dtype=np.int64).view(np.uint64)))
    shards = max(1, -(-total * (length + GRAM) // shard_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _batches(batches):
            rows = list(items_of(some, heavy.value, shards, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["shard", "items", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items, spans in zip(batch.column("items"), batch.column("spans")):
                known = [unpack(s, SPAN)[0] for s in spans.as_py()]
                for key, tag, lo, hi in [solve(items.as_py(), length), *known]:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(tag, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["key", "tag", "lo", "hi"])

    dealt = docs.mapInArrow(deal, "shard long, items binary, spans binary")
    groups = dealt.groupBy("shard").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
    found = groups.mapInArrow(run, "key long, tag long, lo int, hi int")
    spans = found.groupBy("key", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            out = []
            for some in batch.column("spans"):
                lo, hi = (some.values.field(i).to_numpy() for i in (0, 1))
                out.append([{"lo": a, "hi": b} for a, b in merged(list(zip(lo.tolist(), hi.tolist())))])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tag"), pa.array(out, kind)], ["key", "tag", "spans"])

    return saved(spans.mapInArrow(merge, "key long, tag long, spans array<struct<lo:int,hi:int>>"), "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, spans, kept (the remaining bytes).

    A byte goes when a string of ``length`` bytes that covers it also starts in a document with a
    smaller id; strings are judged on the input and don't cross documents. Equal strings have one
    anchor in them and meet in that anchor's shard, whose items (anchors with the bytes around
    them) make one text: its suffix array is induced, and places that share ``length`` bytes with
    their predecessor form a group, of which the least id is known.

    Null text is empty. A null id is larger than any other. Rows of one id don't take bytes from
    each other; where ids repeat, rows are told apart by a hash of the text.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    ).withColumn("key", F.coalesce("id", F.lit(LAST)))
    repeated = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("tag", F.lit(0).cast("long") if repeated else F.xxhash64("text"))
    spans = repeated_spans(rows.select("key", "tag", "text"), length, shard_bytes)
    held = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    small = 64 * held[0] + 16 * (held[1] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(spans) if small else spans, ["key", "tag"], "left")
    spans_or_none = F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>"))
    gap = F.aggregate(
        spans_or_none,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("parts")),
        lambda acc, s: F.struct(
            s["hi"].alias("at"), F.concat(acc["parts"], F.array(F.substring("text", acc["at"] + 1, s["lo"] - acc["at"]))).alias("parts")
        ),
    )
    rest = F.substring("text", F.col("gap.at") + 1, F.octet_length("text"))
    kept = F.when(F.size("spans") > 0, F.concat(F.aggregate("gap.parts", F.lit(b""), lambda acc, x: F.concat(acc, x)), rest)).otherwise(F.col("text"))
    return joined.withColumn("spans", spans_or_none).withColumn("gap", gap).select(
        F.col("id").alias(id_col),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["hi"] - s["lo"])).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "spans",
        kept.alias("kept"),
    )
