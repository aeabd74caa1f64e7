"""What a job's pages carry on from one to the next, and the document they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.functions.tokens import open_environments


def tail(lines: Column, n: int) -> Column:
    """The last ``n`` elements, all of a shorter array."""
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.lit(n))


def context_tail(pages: DataFrame, keys: list[str], at: str, text: str, verified: Column, n: int = 40) -> DataFrame:
    """``pages`` with ``context``: the last ``n`` non-blank lines of verified pages before each.

    A page gives its last ``n`` lines only, and of the pages before it at most ``n`` with lines
    are flattened; pages without any are null, which the window leaves out.
    """
    own = F.filter(F.transform(T.split_lines(F.col(text)), T.rstrip), lambda x: x != "")
    lined = pages.withColumn("_own", F.when(verified, tail(own, n)))
    lined = lined.withColumn("_own", F.when(F.size("_own") > 0, F.col("_own")))
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return lined.withColumn("context", tail(F.flatten(tail(F.collect_list("_own").over(w), n)), n)).drop("_own")


def environments_before(pages: DataFrame, keys: list[str], at: str, text: str, verified: Column) -> DataFrame:
    """``pages`` with ``open_envs``: names open before each page.

    Only the begin and end tokens of verified pages are gathered along a job and folded.
    """
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"\\(?:begin|end)\{[A-Za-z*]+\}"), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    marked = pages.withColumn("_tokens", F.when(verified, tokens).otherwise(F.array().cast("array<string>")))
    before = F.array_join(F.flatten(F.collect_list("_tokens").over(w)), "")
    return marked.withColumn("open_envs", open_environments(before)).drop("_tokens")


def ordered_bodies(pages: DataFrame, keys: list[str], at: str, text: str) -> DataFrame:
    """The pages' texts of each job in order, as one body."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("text"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("body"))


def documents(pages: DataFrame, keys: list[str], at: str, text: str, preamble: Column) -> DataFrame:
    """One document for each job: bodies in order, open environments closed, CJK loaded where any page has it."""
    bodies = ordered_bodies(pages, keys, at, text)
    cjk = pages.groupBy(*keys).agg(F.bool_or(T.has_cjk(F.col(text))).alias("cjk"), F.count("*").alias("pages"))
    out = bodies.join(cjk, keys).withColumn("body", T.strip(F.col("body")))
    stack = open_environments(F.col("body"))
    head = F.when(F.col("cjk"), T.with_cjk(preamble)).otherwise(preamble)
    engine = F.when(F.col("cjk"), F.lit("xelatex")).otherwise("pdflatex")
    return out.withColumns({"tex": T.document(head, T.closed(F.col("body"), stack)), "engine": engine, "n_closed": F.size(stack)}).drop("body")


def page_status(pages: DataFrame) -> DataFrame:
    """``pages`` (compile_ok, attempts, autofixed) with ``status``."""
    first = (F.col("attempts") <= 1) & ~F.coalesce(F.col("autofixed"), F.lit(False))
    return pages.withColumn("status", F.when(~F.coalesce(F.col("compile_ok"), F.lit(False)), "failed").when(first, "ok").otherwise("fixed"))


def job_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages, pages_ok and ok of each job."""
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages"), F.count_if(F.col("status") != "failed").alias("pages_ok"), F.bool_and(F.col("status") != "failed").alias("ok")
    )


def autofix_accepted(compiles: Column, before: Column, after: Column) -> Column:
    """a repair counts if the page compiles or its first error is another one."""
    return compiles | ~T.signature(F.get(before, 0)).eqNullSafe(T.signature(F.get(after, 0)))


def log_errors(logs: DataFrame, keys: list[str], text: str, most: int = 10) -> DataFrame:
    """(n, message, line) of a compiler log's errors, the line from the next five lines of the log."""
    lines = logs.select(*keys, F.posexplode(T.split_lines(F.col(text))).alias("pos", "row"))
    error = r"^(?:!\s+|(?:.+?\.tex:\d+):\s)(.+)$"
    w = Window.partitionBy(*keys).orderBy("pos")
    number = F.regexp_extract("row", r"^l\.(\d+)", 1)
    marked = lines.withColumn("_at", F.when(number != "", number.cast("int")))
    line = F.coalesce(*[F.lead("_at", k).over(w) for k in range(1, 6)])
    marked = marked.withColumns({"line": line, "message": F.regexp_extract("row", error, 1)})
    kept = marked.where((F.col("message") != "") & ~F.col("message").rlike(r"^(?:Emergency stop|See the LaTeX manual)"))
    return kept.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select(*keys, "n", T.strip(F.col("message")).alias("message"), "line")


def bold_labels(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """P15 to P17 over whole pages: lines inside displays and environments of math stay as they are.

    A page's lines are an array with the depth before each, so it stays one row.
    """
    from folium.functions.tokens import display_depth

    lines = T.split_lines(F.col(text))
    math = r"(?:equation|align|alignat|gather|multline|flalign|eqnarray)\*?|displaymath|math|array|aligned|cases|tikzpicture|tikzcd|verbatim|lstlisting|tabular"
    step = lambda acc, line: F.struct(
        display_depth(line, acc["display"]).alias("display"),
        F.greatest(acc["env"] + F.regexp_count(line, F.lit(rf"\\begin\{{(?:{math})\}}")) - F.regexp_count(line, F.lit(rf"\\end\{{(?:{math})\}}")), F.lit(0)).alias("env"),
        F.array_append(acc["out"], F.when((acc["display"] > 0) | (acc["env"] > 0), line).otherwise(T.label_bold(line))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("display"), F.lit(0).alias("env"), F.array().cast("array<string>").alias("out"))
    return pages.withColumn(text, F.array_join(F.aggregate(lines, start, step, lambda s: s["out"]), "\n"))
