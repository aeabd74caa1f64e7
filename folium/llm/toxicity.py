"""Toxicity as expected severity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that a model is fitted on at most: a sample by hash of the id, the bound of the fit's memory.
SAMPLE = 12_000
#: Features: hashed words and word beginnings in at least LEAST_DOCS sample documents, the FEATURES most telling.
BITS, LEAST_DOCS, FEATURES, BEGINNINGS = 22, 4, 30_000, (4, 5)
CACHED_WORDS = 400_000
#: Severity for labels that are only 0 and 1: these shares of the toxic documents, by marking features, end grades 1 and 2.
GRADE_CUTS = (1 / 3, 2 / 3)

WORDS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    names = [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]
    return [xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in names]


def text_of(value: pa.Scalar) -> str:
    return value.as_buffer().to_pybytes().decode("utf-8", "replace") if value.is_valid else ""


def words_of(text: str) -> set[str]:
    return set(WORDS(text.lower()))


def text_features(text: str) -> np.ndarray:
    """Distinct features of the whole text."""
    return np.unique(np.array([f for w in words_of(text) for f in word_features(w)], dtype=np.int32))


@dataclass
class Model:
    """P(grade > k) = logistic(score - cuts[k]): one weight for each feature, shared by all thresholds."""

    weights: dict[int, float]
    cuts: tuple[float, ...]

    def above(self, score: float) -> list[float]:
        return [1 / (1 + math.exp(min(max(c - score, -700), 700))) for c in self.cuts]


def fit(rows: list[np.ndarray], grades: np.ndarray, l2: float = 0.3, steps: int = 250, rate: float = 0.1) -> Model:
    """The penalised maximum likelihood model of ``grades`` (0, 1, ...) given each row's distinct features.

    Only features in enough rows count, and of these the most telling ones: those whose share of
    graded rows is farthest from the mean in standard errors. Full-batch Adam, so a fit is
    determined by its rows. Without two grades the weights are empty and every row gets the one.
    """
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or len(set(grades.tolist())) < 2:
        return Model({}, tuple(-50.0 if len(grades) and k < grades.min() else 50.0 for k in range(max(top, 1))))
    size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    names, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), size)
    seen, hits, p = np.bincount(col), np.bincount(col, weights=(grades > 0)[row]), float((grades > 0).mean())
    z = np.abs(hits - seen * p) / np.sqrt(seen * p * (1 - p) + 1e-9)
    z[seen < LEAST_DOCS] = -1
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] >= 0]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    row, col = row[place[col] >= 0], place[col][place[col] >= 0]
    m, n, k = len(chosen), len(rows), np.arange(top)
    share = np.clip(np.array([(grades > t).mean() for t in k]), 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(m), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, steps + 1):
        gaps = np.exp(theta[m + 1 :])
        cuts = theta[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, weights=theta[:m][col], minlength=n)
        below = np.hstack([np.zeros((n, 1)), logistic(cuts[None, :] - score[:, None]), np.ones((n, 1))])
        who = np.arange(n)
        prob = np.maximum(below[who, grades + 1] - below[who, grades], 1e-9)
        slope = below * (1 - below)
        by_score = (slope[who, grades + 1] - slope[who, grades]) / prob
        by_cut = np.zeros(top)
        np.add.at(by_cut, np.minimum(grades, top - 1)[grades < top], -(slope[who, grades + 1] / prob)[grades < top])
        np.add.at(by_cut, grades[grades > 0] - 1, (slope[who, grades] / prob)[grades > 0])
        grad = np.concatenate([np.bincount(col, weights=by_score[row], minlength=m) + l2 * theta[:m], [by_cut.sum()], gaps * np.cumsum(by_cut[::-1])[::-1][1:]])
        mom, var = 0.9 * mom + 0.1 * grad, 0.999 * var + 0.001 * grad * grad
        theta = theta - rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    cuts = theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])
    return Model(dict(zip(names[chosen].tolist(), theta[:m].tolist())), tuple(cuts.tolist()))


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, cuts: tuple[float, ...] = GRADE_CUTS) -> np.ndarray:
    """Grades 0 to 3 for labels 0 and 1: a toxic row's grade grows with its number of marking features.

    A feature marks when it is in LEAST_DOCS sample rows or more and nine in ten of them are toxic.
    """
    if not len(rows) or not toxic.any():
        return np.zeros(len(rows), dtype=np.int64)
    names, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))
    seen, hits = np.bincount(col), np.bincount(col, weights=toxic[row])
    marks = (seen >= LEAST_DOCS) & (hits >= 0.9 * seen)
    marked = np.bincount(row, weights=marks[col], minlength=len(rows))
    edges = np.quantile(marked[toxic > 0], cuts)
    return np.where(toxic > 0, 1 + sum((marked > c).astype(np.int64) for c in edges), 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of the whole text and label of up to ``most`` labelled documents, by hash of the id.

    Of rows that repeat an id the text of least hash counts, and an id's largest label; ids and labels that are null, and ids without a document, don't.
    Features are taken on the executors; only those of the bounded sample come to the driver.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most)
    )
    given = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text")).join(F.broadcast(chosen), "__id")
    least = F.min(F.struct(F.xxhash64("__text").alias("hash"), "__text"))["__text"].alias("__text")
    given = given.groupBy("__id", "__label").agg(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(text_of(t)).tobytes() for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), pa.array(found, pa.binary())], ["id", "label", "features"])

    rows = given.select("__id", "__label", "__text").mapInArrow(run, "id long, label int, features binary").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("features", "ascending")])
    return [np.frombuffer(x, dtype=np.int32) for x in rows["features"].to_pylist()], rows["label"].to_numpy().astype(np.int64)


def fitted(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model of ``docs``' labels; two-valued labels are given severity grades first."""
    rows, label = labelled_sample(docs, labels, **options)
    grades = severity_grades(rows, label) if len(label) and label.max() <= 1 else np.maximum(label, 0)
    return fit(rows, grades)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic; same columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return severities(packed, model, ["doc"]).where("not toxic").select("doc.*")


def severities(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, severity, grade, p_toxic and toxic for each row of ``docs``.

    severity is the expected grade, the sum of P(grade > k); grade is that rounded; p_toxic is
    P(grade > 0) and toxic says whether it is at least a half. Null and empty texts are scored
    like a text without features. Rows stay in their partitions.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    made = {"severity": pa.float64(), "grade": pa.int32(), "p_toxic": pa.float64(), "toxic": pa.bool_()}
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL("severity double, grade int, p_toxic double, toxic boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, features = given.value.weights, {}
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                found: set[int] = set()
                for w in words_of(text_of(text)):
                    if (own := features.get(w)) is None:
                        if len(features) > CACHED_WORDS:
                            features.clear()
                        own = features[w] = tuple(f for f in word_features(w) if f in weights)
                    found.update(own)
                above = given.value.above(sum(weights[f] for f in sorted(found)))
                out.append((sum(above), round(sum(above)), above[0], above[0] >= 0.5))
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, made.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *made])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, schema)
