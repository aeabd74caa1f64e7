"""Whether a reading is believable: line counts, gates and the repetition guard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions.text import HAN, is_blank, split_lines

# Lines that are only a label, and lines that only give structure.
LABEL_ONLY = r"^\s*(?:\\textcolor\{[^}]*\}\{)?\\textbf\{[^{}]{0,12}\}\}?\s*$"
STRUCTURAL = (
    r"^\s*(?:\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})*|\\hline|\\centering|\\\\|\\par|\\medskip|\\smallskip|\\bigskip|\\noindent)\s*$"
)
# Window and step in characters, ratio below which output repeats itself.
WINDOW, STEP, RATIO, MOST_CHARS = 2_000, 500, 0.10, 24_000


def content_lines(text: Column) -> Column:
    """lines that say something."""
    return F.filter(split_lines(text), lambda x: ~is_blank(x) & ~x.rlike(LABEL_ONLY) & ~x.rlike(STRUCTURAL))


def line_stats(text: Column) -> Column:
    """Struct of n, chars, blank (share of white space), rich (share of lines with math or Han), mean_length."""
    blank = F.regexp_count(text, F.lit(r"[\s\x1c-\x1f\x85\xa0]")) / F.greatest(F.length(text), F.lit(1))
    says = lambda x: x.contains("$") | x.contains("\\") | (F.regexp_count(x, F.lit(f"[{HAN}]")) >= 2)
    count = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("rich"))
    step = lambda acc, x: F.struct(
        (acc["n"] + 1).alias("n"), (acc["chars"] + F.length(x)).alias("chars"), (acc["rich"] + says(x).cast("int")).alias("rich")
    )

    def finish(acc: Column) -> Column:
        n, chars = acc["n"], acc["chars"]
        return F.struct(
            n.alias("n"), chars.alias("chars"), blank.alias("blank"), F.when(n > 0, acc["rich"] / n).alias("rich"), F.when(n > 0, chars / n).alias("mean_length")
        )

    return F.aggregate(content_lines(text), count, step, finish)


def verdict(stats: Column, expected: Column) -> Column:
    """struct of ok, score and reason, the gates in order; ``stats`` is ``line_stats``' struct."""
    n, score = stats["n"], F.when(expected > 0, F.least(stats["n"], expected)).otherwise(stats["n"]).cast("double")
    thin = ((stats["rich"] < 0.3) & (stats["mean_length"] < 40)) | ((expected >= 4) & (stats["mean_length"] < 25))
    reason = (
        F.when((n == 0) | (stats["chars"] == 0), "empty")
        .when(stats["blank"] > 0.45, "mostly white space")
        .when(thin, "does not look like notes")
        .when((expected >= 4) & (n > 3 * expected + 6), "too many lines")
        .when((expected >= 5) & (n < 0.85 * expected), "lines skipped")
        .otherwise("ok")
    )
    return F.struct((reason == "ok").alias("ok"), F.when(reason.isin("ok", "lines skipped"), score).otherwise(0.0).alias("score"), reason.alias("reason"))


def tail_ratio(text: str | None) -> float | None:
    """Compressed share of the last WINDOW characters; None for shorter texts."""
    if text is None or len(text) < WINDOW:
        return None
    raw = text[-WINDOW:].encode()
    return len(zlib.compress(raw, 6)) / len(raw)


def loop_start(text: str | None, most: int = MOST_CHARS) -> int | None:
    """characters read when a reader that looks every STEP would have stopped; None if it wouldn't."""
    for n in range(STEP, len(text or "") + 1, STEP):
        if n > most:
            return most
        if n >= WINDOW and tail_ratio(text[:n]) < RATIO:
            return n
    return most if len(text or "") > most else None


@F.pandas_udf(T.DoubleType())
def repetition_ratio(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """F5's ratio; SQL has no compression, so batches go through Arrow."""
    for part in texts:
        yield part.map(tail_ratio).astype("float64")


@F.pandas_udf(T.IntegerType())
def stopped_at(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(loop_start).astype("Int32")
