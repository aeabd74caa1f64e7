"""Folds over a transcript's tokens with SQL higher-order functions: open environments and depths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.text import let

ENVIRONMENT = r"\\(?:begin|end)\{[A-Za-z*]+\}"
UNTRACKED = ("document", "verbatim", "verbatim*", "comment")
MATH_SIGN = r"\\[\s\S]|\$\$|\$"


def open_environments(text: Column, before: Column | None = None) -> Column:
    """Names still open after a text, outermost first, given those open before it.

    An end closes the latest of its name and all above it; an end without one changes nothing.
    """
    start = F.coalesce(before, F.array().cast("array<string>")) if before is not None else F.array().cast("array<string>")

    def step(stack: Column, token: Column) -> Column:
        name = F.regexp_extract(token, r"\{(.*)\}", 1)
        depth = F.size(stack) - F.array_position(F.reverse(stack), name).cast("int")
        return (
            F.when(name.isin(*UNTRACKED), stack)
            .when(token.startswith(r"\begin"), F.array_append(stack, name))
            .when(F.array_contains(stack, name), F.slice(stack, F.lit(1), depth))
            .otherwise(stack)
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(ENVIRONMENT), F.lit(0)), start, step)


def environment_depth(text: Column, before: Column) -> Column:
    """Nesting after a text, each begin one more, each end one less but never below none."""
    tokens = F.regexp_extract_all(text, F.lit(ENVIRONMENT), F.lit(0))
    return F.aggregate(tokens, before, lambda d, t: F.when(t.startswith(r"\begin"), d + 1).otherwise(F.greatest(d - 1, F.lit(0))))


def display_depth(line: Column, before: Column) -> Column:
    """Depth of display math after a line; dollar pairs toggle it, inline formulas and escapes are stepped over."""
    state = F.struct(before.cast("int").alias("depth"), F.lit(False).alias("inline"))

    def step(s: Column, t: Column) -> Column:
        depth, inline = s["depth"], s["inline"]
        pair = (t == "$$") & ~inline
        new_depth = (
            F.when((t == r"\[") & ~inline, depth + 1)
            .when((t == r"\]") & ~inline, F.greatest(depth - 1, F.lit(0)))
            .when(pair, F.when(depth > 0, 0).otherwise(1))
            .otherwise(depth)
        )
        # two dollar signs within an inline formula end it and begin another
        new_inline = F.when((t == "$") & (depth == 0), ~inline).otherwise(inline)
        return F.struct(new_depth.cast("int").alias("depth"), new_inline.alias("inline"))

    return F.aggregate(F.regexp_extract_all(line, F.lit(MATH_SIGN), F.lit(0)), state, step, lambda s: s["depth"])


def depths_by_line(lines: Column) -> Column:
    """array<struct<env,display>> before each line of ``lines``, carried from line to line."""
    zero = F.struct(F.lit(0).alias("env"), F.lit(0).alias("display"))

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        after = F.struct(environment_depth(line, last["env"]).alias("env"), display_depth(line, last["display"]).alias("display"))
        return F.array_append(acc, after)

    return F.aggregate(lines, F.array(zero), step)


def paragraphs(text: Column) -> Column:
    """An empty line between lines outside environments and displays."""
    state = let(F.split(text, "\n", -1), lambda lines: F.struct(lines.alias("lines"), depths_by_line(lines).alias("depth")))
    part = lambda s: F.transform(s["lines"], lambda x, i: F.concat(x, F.when(_breaks(s, i), "\n").otherwise("")))
    return F.array_join(let(state, part), "\n")


def _breaks(state: Column, i: Column) -> Column:
    line, after = F.get(state["lines"], i), F.get(state["lines"], i + 1)
    depth = F.get(state["depth"], i + 1)
    joined = F.regexp_like(line, F.lit(r"\\\\\s*$")) | F.regexp_like(after, F.lit(r"^\s*(?:\\end|\\item|&|\\\\)"))
    free = (depth["env"] == 0) & (depth["display"] == 0)
    return F.coalesce((F.trim(line) != "") & (F.trim(after) != "") & free & ~joined, F.lit(False))
