"""Pages to documents: the stages of a transcription job as one lazy plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions import repair, text
from folium.functions.plugins import Compiler, Recognizer
from folium.operators import sequence


def read_pages(pages: DataFrame, engine: Recognizer, keys: list[str], at: str = "page_index") -> DataFrame:
    """``pages`` with ``latex``, ``engine_failed`` and ``error``: each page read on its own, batches of pages in parallel.

    Engines are outside services whose answers vary: write the result before it is used twice.
    """
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), "latex string, engine_failed boolean, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.to_dict("records"):
                try:
                    rows.append((engine.transcribe(page, "", []), False, None))
                except Exception as e:  # an engine's failure is an outcome of its page
                    rows.append((None, True, str(e)))
            yield batch.assign(**dict(zip(("latex", "engine_failed", "error"), map(list, zip(*rows)))) if rows else {"latex": [], "engine_failed": [], "error": []})

    return pages.mapInPandas(run, kinds)


def finished(pages: DataFrame, keys: list[str], latex: str = "latex") -> DataFrame:
    """The rewrites of a reading in their order: body, figures out of math, bold labels, layout."""
    body = text.figures_out_of_math(text.body_only(text.reply_latex(F.col(latex))))
    out = sequence.bold_labels(pages.withColumn(latex, body), keys, latex)
    return out.withColumn(latex, text.corner_heading(text.margin_labels_spaced(text.indicator(F.col(latex)))))


def verified(pages: DataFrame, compiler: Compiler, keys: list[str], at: str = "page_index", latex: str = "latex") -> DataFrame:
    """``pages`` with compile_ok, attempts, autofixed, errors and status.

    Each page is compiled by itself, open environments closed, so a job costs what its pages cost;
    wide tables are fitted first, which needs balanced nesting; the cheap repair is tried only on
    pages that fail, and kept by the rule of ``autofix_accepted``.
    """
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), "errors array<string>, repaired string, repaired_errors array<string>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[latex] = [repair.fitted(t)[0] for t in batch[latex]]
            errors = [compiler.compile(t or "") for t in batch[latex]]
            fixed = [repair.repaired(t)[0] if e else t for t, e in zip(batch[latex], errors)]
            again = [compiler.compile(f or "") if e else [] for f, e in zip(fixed, errors)]
            yield batch.assign(errors=errors, repaired=fixed, repaired_errors=again)

    checked = pages.mapInPandas(run, kinds)
    clean = F.size("errors") == 0
    taken = ~clean & sequence.autofix_accepted(F.size("repaired_errors") == 0, F.col("errors"), F.col("repaired_errors"))
    out = checked.withColumns(
        {
            "autofixed": taken,
            "compile_ok": (clean | (taken & (F.size("repaired_errors") == 0))) & ~F.coalesce(F.col("engine_failed"), F.lit(False)),
            latex: F.when(taken, F.col("repaired")).otherwise(F.col(latex)),
            "errors": F.when(taken, F.col("repaired_errors")).otherwise(F.col("errors")),
            "attempts": F.lit(1),
        }
    ).drop("repaired", "repaired_errors")
    return sequence.page_status(out)


def transcribed(pages: DataFrame, engine: Recognizer, compiler: Compiler, keys: list[str], preamble: str, at: str = "page_index") -> tuple[DataFrame, DataFrame]:
    """(pages with their outcome, documents): reading, finishing, verifying and assembling.

    A page that failed is in its document as a note and comments.
    """
    outcome = verified(finished(read_pages(pages, engine, keys, at), keys), compiler, keys, at)
    note = text.unverified(F.col(at), F.coalesce("latex", F.lit("")), F.lit("did not compile"))
    shown = outcome.withColumn("body", F.when(F.col("compile_ok"), F.col("latex")).otherwise(note))
    return outcome, sequence.documents(shown, keys, at, "body", F.lit(preamble))
