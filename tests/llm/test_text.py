import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from folium.llm import bpe, token_counts, toxicity
from folium.llm.queries import PATTERN, VOCABULARY
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def raw():
    with open(VOCABULARY, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(raw):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})


def odd_texts():
    rnd = random.Random(1)
    pool = [chr(x) for x in range(0x250)] + list(" ᠎  ​    　一丁가٠२Ⅰ﻿́") + ["\U0001f600", "\U0001d7d8"]
    near = [" ", "\n", "\t", "\x85", "\xa0", "a", "B", "é", "1", "²", "'", "s", "t", "!", "\x1d", "　", "中"]
    texts = ["", "a", "  ", "\n\n x", "don't we'll 's", " " * 50 + "x", "!" * 300, "x" * 3000, "ab" * 1500 + " c"]
    texts += ["".join(rnd.choices(pool, k=rnd.randint(1, 60))) for _ in range(400)]
    return texts + ["".join(rnd.choices(near, k=rnd.randint(1, 40))) for _ in range(400)]


def test_codec(raw, reference):
    codec, texts = bpe.Codec(raw, PATTERN), odd_texts()
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert codec.merged(b"abcabc" * 300) == reference.encode_ordinary("abcabc" * 300)
    with pytest.raises(ValueError):
        codec.decode([np.array([10**6])])


def test_round_trip(odd, none, reference):
    found = bpe.round_trip(odd, VOCABULARY, PATTERN, ["doc_id", "row"]).collect()
    want = [(r.doc_id, reference.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect()]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in found), key=repr) == sorted(want, key=repr)
    ids = bpe.encode(odd, VOCABULARY, PATTERN, ["doc_id"])
    back = bpe.decode(ids, VOCABULARY, PATTERN, ["doc_id"]).collect()
    assert sorted(hashlib.md5(r.decoded).hexdigest() for r in back) == sorted(hashlib.md5(w[2]).hexdigest() for w in want)
    assert bpe.round_trip(none, VOCABULARY, PATTERN, ["doc_id"]).count() == 0


def test_edits(raw, reference):
    rnd, counter = random.Random(3), token_counts.Counter(raw, PATTERN)
    alphabet = [" ", "\n", "\t", "a", "b", "é", "1", "'", "s", "t", "!", "  ", "   ", " word", "'ll", "中", "\x85"]
    texts = [sentence(i, 400) for i in range(10)] + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 600))) for _ in range(80)] + [" " * 400, "a" * 500, ""]
    encoded = size = 0
    for text in texts:
        doc = token_counts.Counted.of(text, counter)
        for _ in range(6):
            inserted = "".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 3, 30, 400])))
            at, n = rnd.randint(-2, len(doc.text) + 3), rnd.choice([0, 1, 3, 20, 300])
            a = min(max(at, 0), len(doc.text))
            want = doc.text[:a] + inserted + doc.text[min(a + n, len(doc.text)) :]
            doc.edit(at, n, inserted, counter)
            size += len(want)
            assert doc.text == want and doc.tree.total == (len(want), len(reference.encode_ordinary(want)))
            assert doc.tree.rows().sum(axis=0).tolist() == list(doc.tree.total)
        encoded += doc.encoded
    assert encoded < size / 2


def test_edited_counts(odd, none, reference):
    edits = F.array(F.struct(F.lit(5).alias("at"), F.lit(3).alias("n_deleted"), F.lit(" new words ").alias("inserted")), F.lit(None))
    got = token_counts.edited_counts(odd, VOCABULARY, PATTERN, edits).collect()
    want = []
    for r in odd.collect():
        t = r.text or ""
        e = t[:5] + " new words " + t[8:]
        want.append((r.doc_id, len(reference.encode_ordinary(t)), len(reference.encode_ordinary(e)), len(e)))
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert all(sum(r.leaf_tokens) == r.n_tokens_edited for r in got)
    assert token_counts.edited_counts(none, VOCABULARY, PATTERN, F.lit(None)).count() == 0


def test_toxicity_held_out(spark):
    rnd = random.Random(4)
    bad = ["vilem" + e for e in ("a", "ok", "ist", "ung", "ers")] + ["nastyword", "rotten"]
    rows = []
    for i in range(900):
        words = sentence(i, 60).split()
        n = rnd.choice([1, 2, 3, 6]) if i % 5 == 0 else 0
        for w in rnd.choices(bad, k=n):
            words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words), n))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n > 0)) for i, _, n in rows if i < 600] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == 3
    found = {r.doc_id: r for r in toxicity.severities(docs, model, ["doc_id"]).collect()}
    held = [(found[i], n) for i, _, n in rows if i >= 600]
    assert sum(r.toxic != (n > 0) for r, n in held) <= 3
    mean = lambda k: np.mean([r.severity for r, n in held if n == k])
    assert mean(0) < mean(1) < mean(6)
    again = toxicity.fitted(docs.repartition(5), labels.repartition(3))
    assert again == model


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    for given in (labels, empty):
        model = toxicity.fitted(odd, given)
        kept = toxicity.without_toxic(odd, model)
        assert kept.count() == odd.count() and kept.columns == odd.columns
        assert toxicity.severities(none, model, ["doc_id"]).count() == 0
