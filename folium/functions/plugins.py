"""What users plug in: engines that read pages, and compilers that verify documents."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from folium.functions.repair import repaired


class Recognizer(Protocol):
    """V1, V2: an engine. Only ``transcribe`` must be there; the others may give None for "cannot"."""

    name: str

    def transcribe(self, page: dict, context: str, open_envs: list[str], guidance: str | None = None) -> str: ...


CAPABILITIES = ("transcribe_strip", "repair_text", "transcribe_table", "transcribe_colors", "locate_figures", "close")


def capabilities(engine) -> list[str]:
    return [c for c in CAPABILITIES if callable(getattr(engine, c, None))]


class Compiler(Protocol):
    """V4: gives the errors of a document, none if it compiles."""

    def compile(self, tex: str) -> list[str]: ...


class StructureCompiler:
    """Errors that can be seen without a TeX system: what the repairs would change, and braces."""

    def compile(self, tex: str) -> list[str]:
        body = re.sub(r"(?s)\A.*?\\begin\{document\}|\\end\{document\}.*\Z", "", tex)
        errors = [c for c in repaired(body)[1]]
        bare = re.sub(r"\\[{}\\]|%[^\n]*", "", body)
        if bare.count("{") != bare.count("}"):
            errors.append("braces don't match")
        return errors


class Skeleton:
    """An engine without a model: a line for each segmented region."""

    name = "heuristic"

    def transcribe(self, page: dict, context: str, open_envs: list[str], guidance: str | None = None) -> str:
        lines = [f"% page {page['page_index']}: {len(page['regions'])} segmented regions"]
        for i, r in enumerate(page["regions"], 1):
            if guidance:
                lines.append(f"\\text{{[region {i}: {r['kind']}]}}\n")
            elif r["kind"] == "math":
                lines.append(f"\\begin{{equation*}} \\text{{[math region {i}]}} \\end{{equation*}}")
            else:
                lines.append(f"\\text{{[text region {i}]}}")
        return "\n".join(lines)


ENGINES: dict[str, Callable[..., Recognizer]] = {"heuristic": Skeleton}


def register(name: str, factory: Callable[..., Recognizer]) -> None:
    """V3"""
    ENGINES[name] = factory


def engines_for(mode: str, **settings) -> tuple[Recognizer, Recognizer | None]:
    """(primary, fixer): a hybrid reads with the offline engine and repairs with a model, if one is registered."""
    if mode == "hybrid":
        return ENGINES["heuristic"](), ENGINES["vlm"](**settings) if "vlm" in ENGINES else None
    if mode not in ENGINES:
        raise ValueError(f"no engine {mode!r} is registered")
    return ENGINES[mode](**settings), None


def register_sql(spark) -> None:
    """V6: the repairs and folds as SQL functions: ``autofix(text)``, ``latex_tokens(text)``."""
    from pyspark.sql.functions import udtf

    from folium.functions import quality, repair

    spark.udf.register("autofix", repair.autofix)
    spark.udf.register("repetition_ratio", quality.repetition_ratio)

    @udtf(returnType="pos int, token string")
    class LatexTokens:
        def eval(self, text: str):
            for i, m in enumerate(re.finditer(r"\\[A-Za-z]+|\\.|[{}$&#^_%]", text or "")):
                yield i, m[0]

    spark.udtf.register("latex_tokens", LatexTokens)


