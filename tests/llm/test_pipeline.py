import math
import os
import random

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import bpe, mixing, queries, simhash, toxicity
from folium.llm.mixing import SLICE_ROWS
from tests.llm.conftest import SCHEMA, sentence
from tests.llm.test_dedup import distance, groups, norm, print_of
from tests.llm.test_tables import water


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd, rows = random.Random(8), []
    for i in range(48):
        lines = [sentence(rnd.randrange(400), 40) for _ in range(3)]
        if i % 6 == 0:
            lines[1] = " ".join(["vilemok", "nastyword", "rotten", lines[1], "vilemung"])
        if i % 7 == 3:
            lines = [rows[i - 1][1].split("\n")[0].replace("pine", "pines", 1), *lines[1:]]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
    rows += [(60, None, None, None, None), (61, "", "en", "s0", 0), (62, rows[5][1], "en", None, 1), (None, sentence(999, 30), "en", "s1", 2)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(48)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def lines_kept(rows):
    """Line dedup in plain Python: rows (id, text, ...) with the text that stays."""
    key = lambda r: r[0] if r[0] is not None else 2**63 - 1
    seen = [(key(r), k, norm(x)) for r in rows if r[1] is not None for k, x in enumerate(r[1].split("\n"))]
    seen = [s for s in seen if s[2]]
    names = sorted({s[2] for s in seen})
    near = lambda i, j: distance(names[i], names[j]) <= int(0.2 * max(len(names[i]), len(names[j])) + 1e-9)
    root = groups(len(names), [(i, j) for i in range(len(names)) for j in range(i) if near(i, j)])
    first = {}
    for i, k, n in seen:
        r = root[names.index(n)]
        first[r] = min(first.get(r, (i, k)), (i, k))
    gone = {(i, k) for i, k, n in seen if first[root[names.index(n)]] != (i, k)}
    cut = lambda r: None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if (key(r), k) not in gone)
    return [(r[0], cut(r), *r[2:]) for r in rows]


def mixed(rows):
    """Source mixing in plain Python: how often each row is taken."""
    import hashlib

    size = lambda r: len((r[1] or "").split())
    assert len(rows) <= SLICE_ROWS
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    target, out = water(sizes), []
    for s in sizes:
        name = "-" if s is None else "+" + s
        shift = int(hashlib.md5(f"42|{name}".encode()).hexdigest()[:8], 16) / 2**32
        own = [r for r in rows if r[3] == s]
        own.sort(key=lambda r: (math.floor(math.log2(size(r) + 1.0) * 6.0), size(r)))
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        out.append((s, sum(math.floor(shift + k * rate) - math.floor(shift + (k - 1) * rate) for k in range(1, len(own) + 1))))
    return dict(out)


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]

    def score(t):
        return sum(model.weights.get(int(f), 0.0) for f in toxicity.text_features(t or ""))

    clean = [r for r in rows if model.above(score(r[1]))[0] < 0.5]
    assert {r[0] for r in rows} - {r[0] for r in clean} == {i for i in range(0, 48, 6)}
    lined = lines_kept(clean)
    runs = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in ((r[1] or "").lower().split() for r in lined)]
    root = groups(len(lined), [(i, j) for i in range(len(lined)) for j in range(i) if len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j])])
    best = {}
    for r, g in zip(lined, root):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    kept = sorted(best.values(), key=repr)

    stage = docs
    for name, fn in corpus_pipeline.STAGES[:3]:
        stage = fn(spark, stage, sf_dir)
        assert stage.columns == docs.columns, name
    got = sorted(((r.doc_id, r.text) for r in stage.collect()), key=repr)
    assert got == sorted(((r[0], r[1]) for r in kept), key=repr)

    with open(corpus_pipeline.VOCABULARY, "rb") as f:
        raw = f.read()
    reference = tiktoken.Encoding("own", pat_str=corpus_pipeline.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})
    final = corpus_pipeline.run(spark, sf_dir).collect()
    taken, text = mixed(kept), {r[0]: r[1] or "" for r in kept}
    count = {}
    for r in final:
        assert r.ids == reference.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)
        count[r.source] = count.get(r.source, 0) + 1
    assert {s: n for s, n in taken.items() if n} == count
    assert max(np.unique([str(r.doc_id) for r in final], return_counts=True)[1]) <= 2


def test_names_and_sql():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_pass_all_stages(spark, odd, sf_dir):
    docs = odd.withColumn("decoded", F.lit(1))
    for _, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, sf_dir)
    assert docs.count() > 0


def test_a_mix_does_not_depend_on_partitions(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    rows = [sorted(map(tuple, mixing.mixed(docs.repartition(n)).collect()), key=repr) for n in (2, 7)]
    assert rows[0] == rows[1]


def test_one_row_of_an_id_in_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en", "s", 0) for i in range(50)] + [(2, "other", "en", "s", 0)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    features, marks = toxicity.labelled_sample(docs, labels, most=2)
    assert len(features) == 2 and sorted(marks) == [0, 1]


def test_near_documents_are_those_of_similar_shingles(spark):
    rnd, texts = random.Random(3), []
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(5))
    for _ in range(40):
        words = [word() for _ in range(rnd.choice([60, 150, 400]))]
        new = [word() if rnd.random() < 0.02 else w for w in words]
        texts += [" ".join(words), " ".join(new).upper(), " ".join([*words[: len(words) // 2], *(word() for _ in range(30))])]
    texts += ["few words", "few  Words", "", None, " "]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)

    def runs(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [runs(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = [simhash.majority(simhash.shingle_set((t or "").encode(), 5)) for t in texts]
    far = [(prints[i] ^ prints[j]).bit_count() for i, j in links]
    assert sum(x > 3 for x in far) > 5 and sum(x > simhash.STAGE_RADIUS for x in far) <= 0.1 * len(far)
    links = [p for p, x in zip(links, far) if x <= simhash.STAGE_RADIUS]
    got = {r.doc_id for r in corpus_pipeline.drop_near_documents(spark, docs, "").collect()}
    assert got == set(groups(len(texts), links))


def test_wide_masks_cover_and_large_buckets_are_masked_again(spark):
    masks = simhash.wide_masks(list(range(64)), 11)
    rnd = np.random.default_rng(4)
    for _ in range(300):
        bits = rnd.choice(64, 11, replace=False)
        assert any(not any(m >> int(b) & 1 for b in bits) for m in masks)
    base = int(rnd.integers(0, 2**62))
    prints = {base}
    for _ in range(150):
        prints.add(int(rnd.choice(sorted(prints))) ^ sum(1 << int(b) for b in rnd.choice(62, int(rnd.integers(3, 12)), replace=False)))
    prints = sorted(prints | {int(x) for x in rnd.integers(0, 2**62, 150)})
    near = {(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 11}
    rows = spark.createDataFrame([(p, i, 100) for i, p in enumerate(prints)], "print long, root long, size long")
    for bucket in (30, 4096):
        got = {(prints.index(r.b), prints.index(r.a)) for r in simhash.similar_prints(rows, 11, True, bucket).collect()}
        assert got == near
        nearest = {(prints.index(r.b), prints.index(r.a)) for r in simhash.similar_prints(rows, 11, False, bucket).collect()}
        assert nearest <= near and {i for p in nearest for i in p} == {i for p in near for i in p}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = [tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()]
    rows = queries.QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(columns)) for r in rows.collect()]
    assert sorted(rows.columns) == sorted(columns) and len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a == pytest.approx(b) if name == "op10_mixing" else a == b
