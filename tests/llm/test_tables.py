import base64
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import embedding_dedup, mixing, warc
from tests.llm.test_dedup import groups


def test_vectors(spark):
    rnd = np.random.default_rng(0)
    base = rnd.standard_normal((12, 16))
    rows = []
    for i in range(240):
        v = base[i % 12] + rnd.standard_normal(16) * rnd.choice([0, 0.03, 0.06, 0.1, 0.5])
        rows.append((i, v.tolist(), None if i % 50 == 7 else i % 4 // 2))
    rows += [(300, rows[0][1], rows[0][2]), (301, [2 * x for x in rows[0][1]], rows[0][2]), (None, rows[1][1], rows[1][2]), (5, rows[5][1], rows[5][2])]
    rows += [(310, None, 1), (311, [0.0] * 16, 1), (312, [None] + [1.0] * 15, 1), (313, [float("nan")] * 16, 1), (314, [float("inf")] * 16, 1), (315, [], 1), (316, [1.0] * 3, 1), (317, [1.0] * 3, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).withColumn("cls", F.lit(2)).repartition(3)
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and lab is not None for _, v, lab in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links.append((i, j))
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    root = groups(len(rows), links)
    least = {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = [(r[0], int(k), least.get(g), r[0] == least.get(g)) for r, k, g in zip(rows, n, root)]
    assert len(links) > 500
    for block in (16, 1024):
        got = [tuple(r) for r in embedding_dedup.near_vectors(table, block=block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert embedding_dedup.near_vectors(table.where("false")).count() == 0


def water(sizes, weights=(3, 1, 2)):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, odd, none):
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rnd.integers(0, 80) ** 1.5)), ["a", "b", "c", None][int(rnd.choice(4, p=[0.7, 0.2, 0.05, 0.05]))]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water(sizes)
    assert {r.doc_id: r.size for r in got} == {i: len(t.split()) for i, t, _ in rows}
    assert all(r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2 for r in got)
    for s, target in want.items():
        taken = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(taken - target) <= max(0.01 * target, 2 * 715)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    rows = odd.collect()
    found = mixing.mix(odd).collect()
    assert len(found) == len(rows) and sorted(r.size for r in found) == sorted(len((r.text or "").split()) for r in rows)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in found)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_targets_match_sharing(spark):
    rnd = np.random.default_rng(5)
    for _ in range(6):
        sizes = {f"s{i}": int(rnd.integers(0, 1000) ** 2) for i in range(int(rnd.integers(1, 9)))} | {None: int(rnd.integers(0, 500))}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = water(sizes)
        assert {r.source: r.target for r in got} == pytest.approx(want)


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives(spark):
    bodies = ["<p>a</p>", "<p>a</p>", "", None, "é" * 9000, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 50, "é" * 9000, "0\r\n\r\n", "<p>a</p>"]
    rows = [(i, f"http://x/{i}\r\nWARC-Type: bad", b) for i, b in enumerate(bodies)] + [(1, None, "<p>a</p>"), (4, "u", "é" * 9000), (None, "u", "only null"), (None, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(2)
    first = {}
    for i, _, b in rows:
        if i is not None:
            first[b or ""] = min(first.get(b or "", i), i)
    for least in (0, 10):
        want = []
        for i, _, b in rows:
            raw, f = (b or "").encode(), first.get(b or "")
            again = len(raw) >= least and f is not None and f != i
            want.append((i, len(raw), sha(raw), "revisit" if again else "response", f if again else None, True))
        got = warc.page_archives(spark, pages, least_bytes=least, segment_bytes=700).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.page_archives(spark, pages.where("false")).count() == 0


def test_broken_archives(spark, tmp_path):
    payload = b"hello " * 500
    records = warc.page_records(1, "http://x", payload, sha(payload), None, 800)
    assert len(records) > 3
    other = warc.page_records(2, "http://y", b"small", sha(b"small"), None, 800)
    whole = b"".join(r + b"\r\n\r\n" for r in [records[2], *other, *records[:2], *records[3:]])
    lost = b"".join(r + b"\r\n\r\n" for r in records[:2] + records[3:])
    for name, data, ok in (("whole", whole, True), ("lost", lost, False)):
        (tmp_path / name).mkdir()
        with gzip.open(tmp_path / name / "a.warc.gz", "wb") as f:
            f.write(data)
        got = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/{name}").collect()}
        assert got["1"].ok is ok and (not ok or bytes(got["1"].payload) == payload)
    assert list(warc.records_of(io.BytesIO(whole)))[0][0]["warc-segment-number"] == "3"
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archives_with_records_that_cannot_be_read(spark, tmp_path):
    good = [warc.page_records(i, "u", b"body", sha(b"body"), None, 800)[0] for i in (1, 2, 3)]
    bad = {
        "cut": good[0] + warc.END + good[1][:-5],
        "no_id": good[0] + warc.END + warc.record([("WARC-Type", "response")], b"x") + warc.END + good[2],
        "no_length": good[0] + warc.END + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n" + good[2],
        "segment": good[0] + warc.END + warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Segment-Number", "one")], b"x") + warc.END + good[2],
        "noise": b"not an archive",
        "short": gzip.compress(good[0] * 3)[:-20],
    }
    for name, data in bad.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    (tmp_path / "fine.warc.gz").write_bytes(gzip.compress(warc.END.join(good)))
    got = warc.read_archives(spark, f"file://{tmp_path}").select("page_id", "ok", "record_type").collect()
    assert sum(not r.ok for r in got) == len(bad)
    fine = [r.page_id for r in got if r.ok]
    assert fine.count("1") >= 5 and fine.count("2") == 1 and fine.count("3") == 3


def test_long_archives_are_streams(spark, tmp_path):
    bodies = [b"", b"a\r\n\r\nWARC/1.1\r\n\r\n" * 40, b"\r\n\r\r\n\r\n\n" * 300, bytes(range(256)) * 300, b"\r\n\r\n"]
    for part in range(3):
        records = [x for i, b in enumerate(bodies) for x in warc.page_records(10 * part + i, "u", b, sha(b), None, 900)]
        members = [gzip.compress(r + warc.END) for r in records]  # one member a record, as crawls have them
        (tmp_path / f"{part}.warc.gz").write_bytes(b"".join(members))
    whole, streamed = (
        {(r.page_id, r.ok, r.payload_digest, bytes(r.payload)) for r in warc.read_archives(spark, f"file://{tmp_path}", whole_bytes=n).collect()} for n in (10**9, 0)
    )
    assert whole == streamed == {(str(10 * p + i), True, sha(b), b) for p in range(3) for i, b in enumerate(bodies)}
    (tmp_path / "plain.warc").write_bytes(b"x")
    with pytest.raises(ValueError, match="compress"):
        warc.read_archives(spark, f"file://{tmp_path}", whole_bytes=0)
