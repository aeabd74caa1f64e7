"""Rewrites of one transcript, as column expressions: no Python runs on the rows.

Functions take and return columns. Where a rewrite counts what it changed, the
function whose name ends in ``_count`` gives the number for the same input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns that results depend on.
BEGIN_DOCUMENT, END_DOCUMENT = r"\begin{document}", r"\end{document}"
PREAMBLE_COMMANDS = ("documentclass", "usepackage", "RequirePackage", "pgfplotsset")
HAN = r"\x{3400}-\x{9fff}"
CJK = (
    r"\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
    r"\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}"
)
CIRCLED = r"\x{2460}-\x{2473}\x{24f5}-\x{24fe}"
CJK_ENGINES = ("xelatex", "lualatex")
FIGBOX = r"\\figbox" + r"\s*\{\s*(-?\d+)\s*\}" * 4
COLOR_RUN = r"\\textcolor\{(\w+)\}\{((?:[^{}]|\{[^{}]*\})*)\}"
CHATTER = (
    r"(?i)^(?:here (?:is|'s) (?:the |a |your )?(?:transcription|latex|output|corrected|updated|revised|full|page).{0,60}[.:]?"
    r"|below (?:is|are) (?:the |a |your )?(?:transcription|latex|output|corrected|updated|table|tabular|page).{0,60}[.:]?"
    r"|(?:transcription|latex|output|the page|the table)\s*[:.]"
    r"|sure[!,.].{0,70}|certainly[!,.].{0,70}"
    r"|i (?:will|'ll|have) (?:now )?(?:transcribed|extracted|read|fixed|corrected).{0,60}[.:]?"
    r"|let me know [a-z0-9 ,.'-]{0,60}[.:]?|hope (?:this|that) helps[.!]?)$"
)

BLANK = r"[\s\x1c-\x1f\x85\xa0]"


def literal(text: str) -> Column:
    return F.lit(text)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{BLANK}+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+", "")


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def split_lines(text: Column) -> Column:
    """The lines of a text at any line boundary, without an empty one after the last boundary; '' has none."""
    parts = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", -1)
    return let(parts, lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


# --- whole replies -----------------------------------------------------------------------------


def body_only(text: Column) -> Column:
    """What a document has between its markers, without preamble, marker and fence lines."""
    text = F.coalesce(text, F.lit(""))
    start, stop = F.lit(BEGIN_DOCUMENT), F.lit(END_DOCUMENT)
    text = F.when(F.locate(BEGIN_DOCUMENT, text) > 0, F.substring(text, F.locate(BEGIN_DOCUMENT, text) + len(BEGIN_DOCUMENT), F.length(text))).otherwise(text)
    text = F.when(F.locate(END_DOCUMENT, text) > 0, F.substring(text, F.lit(1), F.locate(END_DOCUMENT, text) - 1)).otherwise(text)
    text = F.regexp_replace(text, r"(?md)^[ \t]*\\(?:" + "|".join(PREAMBLE_COMMANDS) + r")\b[^\n]*\n?", "")
    text = F.replace(F.replace(text, start), stop)
    text = F.regexp_replace(text, r"(?md)^```[a-zA-Z]*[ \t]*\n?", "")
    return F.when(is_blank(text), "").otherwise(rstrip(F.regexp_replace(text, r"\A\n+|\n+\z", "")))


def commented(text: Column) -> Column:
    """Each line as a comment, blank ones as a bare sign."""
    return join_lines(F.transform(split_lines(text), lambda x: F.when(is_blank(x), "%").otherwise(F.concat(F.lit("% "), x))))


def is_chatter(line: Column) -> Column:
    """a line that only comments on the reply, with neither markup nor Han characters."""
    line = strip(line)
    return line.rlike(CHATTER) & ~line.contains("\\") & ~line.rlike(f"[{HAN}]")


def without_chatter(text: Column) -> Column:
    """The text without such lines at its start and end; lines are looked at only up to the first other one."""

    def leading(lines: Column) -> Column:  # counts up, and turns negative once a line stays
        step = lambda n, x: F.when(n < 0, n).when(is_chatter(x), n + 1).otherwise(-n - 1)
        return F.aggregate(lines, F.lit(0), step, lambda n: F.when(n < 0, -n - 1))

    def inner(lines: Column) -> Column:
        kept = lambda skip: F.slice(lines, skip + 1, F.size(lines) - skip - leading(F.reverse(lines)))
        return let(leading(lines), lambda skip: F.when(skip.isNull(), "").otherwise(strip(join_lines(kept(skip)))))

    return let(split_lines(text), inner)


def reply_latex(text: Column) -> Column:
    """The first fenced block of a reply, else the reply, without chatter."""
    fence = r"(?s)```(?:latex|tex)?\s*\n(.*?)```"
    bare = lambda t: F.when(t.startswith("```"), F.regexp_replace(t, r"\A`+|`+\z", "")).otherwise(t)
    inner = lambda t: F.when(t.rlike(fence), strip(F.regexp_extract(t, fence, 1))).otherwise(let(strip(t), bare))
    return without_chatter(let(F.coalesce(text, F.lit("")), inner))


# --- single signs ------------------------------------------------------------------------------

INDICATOR = r"\\math(?:bb|ds)\s*(?:\{\s*1\s*\}|1)"


def indicator(text: Column) -> Column:
    """The indicator function in an alphabet that has the digit."""
    return F.regexp_replace(text, INDICATOR, r"\\mathbbm{1}")


def indicator_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INDICATOR))


# Fixed value: a circled margin label.
MARGIN_LABEL = r"((?:\\textcolor\{\w+\}\{)?\\textbf\{[" + CIRCLED + r"][^{}\n]{0,12}\}\}?)[ \t]+(?=\S)"


def margin_labels_spaced(text: Column) -> Column:
    """P20: a gap that survives between a circled margin label and what follows it."""
    return F.regexp_replace(text, MARGIN_LABEL, r"$1\\quad ")


def margin_labels_colored(text: Column, color: str) -> Column:
    """Circled margin labels in ``color``, but for those that are."""
    label = r"(?<!\\textcolor\{" + color + r"\}\{)(\\textbf\{[" + CIRCLED + r"][^{}\n]{0,12}\})"
    return F.regexp_replace(text, label, r"\\textcolor{" + color + "}{$1}")


# Fixed value: the line above a corner table.
CORNER_HEADING = r"(\\begin\{wraptable\}\{[^}]*\}\{[^}]*\}[ \t]*\n)([^\n]*\S)(?<!\\\\)(?<!\\par)[ \t]*\n(?=[ \t]*(?:\\fitpage\{)?\\begin\{tabular\})"


def corner_heading(text: Column) -> Column:
    """The line above a corner table ends as a paragraph."""
    return F.regexp_replace(text, CORNER_HEADING, "$1$2\\\\\\\\par\n".replace("\\\\\\\\", "\\\\"))


def fits_wide_tables(text: Column) -> Column:
    """P19 for tables that aren't nested: each one not already scaled is put in ``\\fitpage``."""
    table = r"(?s)(?<!\\fitpage\{)(\\begin\{(tabular[x*]?)\}(?:(?!\\begin\{\2\}).)*?\\end\{\2\})"
    return F.regexp_replace(text, table, r"\\fitpage{$1}")


def _with_sign_escaped(text: Column, sign: str) -> Column:
    """``text`` with a backslash before each bare ``sign``; escapes and comments are tokens of their own and stay."""
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s)\\.|\\|%[^\n]*|{sign}|[^\\%{sign}]+"), F.lit(0))
    done = F.array_join(F.transform(tokens, lambda t: F.when(t == sign, "\\" + sign).otherwise(t)), "")
    return F.when(text.contains(sign), done).otherwise(text)


def bare_hash_escaped(text: Column) -> Column:
    """A literal sign outside comments, unless the text defines macros."""
    macros = r"\\(?:re)?newcommand|\\providecommand|\\def\b|\\(?:re)?newenvironment"
    return F.when(text.rlike(macros), text).otherwise(_with_sign_escaped(text, "#"))


def bare_ampersand_escaped(text: Column) -> Column:
    """P8 for text without environments: a bare alignment sign outside comments is the word."""
    return F.when(text.contains(r"\begin{"), text).otherwise(_with_sign_escaped(text, "&"))


def symbols_as_macros(text: Column, macros: dict[str, str]) -> Column:
    """Each symbol as its macro, between math signs in running text and before a space in math; not in comments.

    Math is what dollar signs enclose; every second piece between them.
    """
    signs = F.lit("[" + "".join(macros) + "]")
    table = lambda form: F.create_map(*[F.lit(x) for k, v in macros.items() for x in (k, form(v))])
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\.|\\|%[^\n]*|\$\$?|[^\\%$]+"), F.lit(0))
    put = lambda t, form: F.array_join(F.transform(F.split(t, "", -1), lambda c: F.coalesce(F.try_element_at(table(form), c), c)), "")

    def step(done: Column, t: Column) -> Column:
        plain = t.rlike(r"^[\\%$]") | ~F.regexp_like(t, signs)
        new = F.when(plain, t).when(done["math"], put(t, lambda v: f"{v} ")).otherwise(put(t, lambda v: f"${v}$"))
        return F.struct(F.array_append(done["out"], new).alias("out"), F.when(t.startswith("$"), ~done["math"]).otherwise(done["math"]).alias("math"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("math"))
    folded = F.aggregate(pieces, start, step, lambda done: F.array_join(done["out"], ""))
    return F.when(F.regexp_like(text, signs), folded).otherwise(text)


# Fixed value: a corner table.
CORNER_TABLE = r"(?s)\\begin\{wraptable\}\{[^}]*\}\{[^}]*\}.*?\\end\{wraptable\}"


def table_after_title(text: Column) -> Column:
    """P25: the first corner table behind the first block, the title; a text without one stays as it is."""

    def moved(table: Column) -> Column:
        at = F.position(table, text)
        rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(table), F.length(text)))
        blocks = F.filter(F.split(strip(rest), r"\n\s*\n", -1), lambda b: ~is_blank(b))
        around = let(blocks, lambda b: F.concat_ws("\n\n", F.slice(b, 1, 1), table, F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))))
        return F.when(table == "", text).otherwise(around)

    return let(F.regexp_extract(text, CORNER_TABLE, 0), moved)


# --- labels ------------------------------------------------------------------------------------

# Words that begin a statement.
LABELS = (
    "Def", "Defn", "Definition", "Thm", "Theorem", "Cor", "Corollary", "Lem", "Lemma", "Prop", "Proposition", "Claim",
    "Conj", "Conjecture", "Pf", "Prf", "Proof", "Eg", r"E\.g", "Ex", "Example", "Rmk", "Rem", "Remark", "Note", "Obs",
    "Observation", "Fact", "Notation", "Sps", "Q", "Ans", "Soln", "Step",
)
HAN_LABELS = ("定理", "定义", "推论", "引理", "命题", "性质", "公理", "例题", "例", "注记", "注", "证明")
LABEL = r"^([ \t]*)((?:" + "|".join(LABELS) + r")(?:\s*\([^()\n]{0,60}\))?\s*[.:])"
HAN_LABEL = r"(?<![\\A-Za-z0-9])(?<!\\textbf\{)((?:" + "|".join(HAN_LABELS) + r")\s*\d+(?:\.\d+)*(?:\s*[(（][^()（）\n$]{0,40}[)）])?\s*[.．:：]?)"
LECTURE = r"(?i)^([ \t]*)(Lecture\s*\d+[^\n\\{}$]*?(?:Week\s*\d+|\d{4}[-/]?\d{1,2}[-/]?\d{1,2}))([ \t]*\.?)\s*$"


def han_labels_bold(line: Column) -> Column:
    """Numbered labels in the parts of a line that aren't inline math."""
    parts = F.regexp_extract_all(line, F.lit(r"\$[^$]*\$|[^$]+|\$"), F.lit(0))
    bold = lambda x: F.regexp_replace(F.regexp_replace(x, HAN_LABEL, r"\\textbf{$1}"), r"(\s+)\}", "}$1")
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("$"), x).when(x.rlike(HAN_LABEL), bold(x)).otherwise(x)), "")


def label_bold(line: Column) -> Column:
    """P15 to P17 for one line outside displays, environments and comments."""
    lecture = F.regexp_replace(line, LECTURE, r"$1\\textbf{$2}$3")
    english = F.regexp_replace(line, LABEL, r"$1\\textbf{$2}")
    return (
        F.when(lstrip(line).startswith("%"), line)
        .when(line.rlike(LECTURE), lecture)
        .when(line.rlike(LABEL) & ~lstrip(line).startswith(r"\textbf"), english)
        .otherwise(han_labels_bold(line))
    )


# --- figures, colours --------------------------------------------------------------------------


def figures_out_of_math(text: Column) -> Column:
    """Math signs around nothing but figure markers go."""
    figs = r"((?:" + FIGBOX.replace("(", "(?:") + r"\s*)+)"
    for before, after in ((r"\\\[", r"\\\]"), (r"\$\$", r"\$\$"), (r"\\begin\{(?:equation\*?|displaymath|align\*?|gather\*?)\}", r"\\end\{(?:equation\*?|displaymath|align\*?|gather\*?)\}"), (r"\$", r"\$")):
        text = F.regexp_replace(text, before + r"\s*" + figs + after, "$1")
    return text


def figure_boxes(text: Column) -> Column:
    """array<struct<x0,y0,x1,y1:int>> of a text's figure markers, in order."""
    pick = lambda k: F.transform(F.regexp_extract_all(text, F.lit(FIGBOX), F.lit(k)), lambda x: x.cast("int"))
    return F.arrays_zip(*[pick(k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"), 1)])


def color_runs(text: Column) -> Column:
    """array<struct<color,plain>> of coloured runs with enough in them; Han characters weigh double."""
    strings = lambda k: F.regexp_extract_all(text, F.lit(COLOR_RUN), F.lit(k))
    runs = F.arrays_zip(strings(1).alias("color"), F.transform(strings(2), plain).alias("plain"))
    weight = lambda x: F.length(x) + F.regexp_count(x, F.lit(f"[{HAN}]"))
    return F.filter(runs, lambda r: weight(r["plain"]) >= 3)


def plain(text: Column) -> Column:
    """The words of a run, without commands and braces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\\[A-Za-z]+", " "), r"[{}\s]+", " "))


def colors_dropped(text: Column, absent: list[str]) -> Column:
    """J6's rewrite: runs in one of the ``absent`` colour names lose the colour, nested ones up to three deep."""
    if absent:
        run = r"(?i)\\textcolor\{(?:" + "|".join(absent) + r")\}\{((?:[^{}]|\{[^{}]*\})*)\}"
        for _ in range(3):
            text = F.regexp_replace(text, run, "$1")
    return text


# --- documents ---------------------------------------------------------------------------------

# The package, and circled numbers among the signs that its font sets.
CJK_PACKAGE = (
    "\\usepackage[UTF8]{ctex}\n"
    '\\ifdefined\\xeCJKDeclareCharClass\\xeCJKDeclareCharClass{CJK}{"2460 -> "24FF}\\fi'
)


def has_cjk(text: Column) -> Column:
    """F2"""
    return F.coalesce(text, F.lit("")).rlike(f"[{CJK}]")


def with_cjk(preamble: Column) -> Column:
    """A preamble that loads the package for CJK once, after its class line."""
    after = F.regexp_replace(preamble, r"(?md)\A((?:(?!\\documentclass)[^\n]*\n)*\\documentclass[^\n]*\n)", "$1" + CJK_PACKAGE.replace("\\", "\\\\").replace("$", "\\$") + "\n")
    bare = F.concat(F.lit(CJK_PACKAGE + "\n"), preamble)
    loaded = preamble.contains("ctex") | preamble.contains("xeCJK")
    return F.when(loaded, preamble).when(preamble.rlike(r"(?md)^\\documentclass"), after).otherwise(bare)


def cjk_engine(engine: Column) -> Column:
    return F.when(engine.isin(*CJK_ENGINES), engine).otherwise("xelatex")


def closers(stack: Column) -> Column:
    """The ends of the open environments, innermost first."""
    return join_lines(F.transform(F.reverse(stack), lambda e: F.concat(F.lit(r"\end{"), e, F.lit("}"))))


def closed(body: Column, stack: Column) -> Column:
    return F.when(F.size(stack) > 0, F.concat_ws("\n", body, closers(stack))).otherwise(body)


def document(preamble: Column, body: Column) -> Column:
    """P37"""
    return F.concat(preamble, F.lit(f"\n{BEGIN_DOCUMENT}\n"), strip(body), F.lit(f"\n{END_DOCUMENT}\n"))


FONT_SIZES, PAPERS = (10, 11, 12), ("a4paper", "letterpaper", "a5paper", "b5paper", "legalpaper", "executivepaper", "a3paper")


def document_class(font: Column, paper: Column, margin: Column, landscape: Column, two_columns: Column) -> Column:
    """Class and geometry lines; values out of range are replaced by 11, a4paper and the nearest margin."""
    size = F.when(font.isin(*FONT_SIZES), font).otherwise(11)
    sheet = F.when(paper.isin(*PAPERS), paper).otherwise(PAPERS[0])
    inches = F.least(F.greatest(F.coalesce(margin.cast("double"), F.lit(1.0)), F.lit(0.25)), F.lit(4.0))
    options = F.concat_ws(",", F.concat(size.cast("string"), F.lit("pt")), sheet, F.when(landscape, "landscape"), F.when(two_columns, "twocolumn"))
    return F.concat(F.lit(r"\documentclass["), options, F.lit("]{article}\n\\usepackage[margin="), F.format_string("%.2f", inches), F.lit("in]{geometry}\n"))


def unverified(index: Column, text: Column, reason: Column) -> Column:
    """A visible note and the source as comments."""
    note = F.concat(F.lit(r"\par\noindent{\color{gray}\small [page "), index.cast("string"), F.lit(": unverified - "), reason, F.lit("; source kept as a comment in the .tex, see the review pane]}\\par"))
    return F.concat_ws("\n", note, commented(text))


def signature(error: Column) -> Column:
    """An error without its line number."""
    return F.regexp_replace(error, r"\s*\(line \d+\)", "")


def masked_key(key: Column) -> Column:
    """P46"""
    return F.when(F.coalesce(key, F.lit("")) == "", "").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("...")))


def safe_stem(name: Column, fallback: Column) -> Column:
    """A file name that is safe everywhere, without its suffix, of 80 characters at most."""
    flat = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "")
    stem = F.regexp_replace(F.regexp_replace(flat, r"(?s)^(.+)\.[^.]+$", "$1"), r"^[ .]+|[ .]+$", "")
    return F.left(F.when(stem == "", fallback).otherwise(F.coalesce(stem, fallback)), F.lit(80))


def settings_problems(s: Column | str) -> Column:
    """what is wrong with a settings struct, in order; an empty array if nothing."""
    v = (lambda n: F.col(f"{s}.{n}")) if isinstance(s, str) else (lambda n: s[n])
    blank = lambda c: is_blank(F.coalesce(c, F.lit("")))
    checks = [
        (~v("engine").isin("hybrid", "vlm", "trocr", "heuristic"), "engine"),
        ((v("engine") == "vlm") & (blank(v("vlm_base_url")) | blank(v("vlm_model"))), "endpoint"),
        (~v("dpi").between(50, 1200), "dpi"),
        (v("max_retries") < 0, "max_retries"),
        (~v("vlm_parallel_workers").between(1, 16), "vlm_parallel_workers"),
        (v("vlm_stall_timeout") < 10, "vlm_stall_timeout"),
        (v("vlm_timeout") < v("vlm_stall_timeout"), "vlm_timeout"),
        (~v("vlm_retries").between(0, 10), "vlm_retries"),
        (~v("vlm_thinking").isin("off", "auto", "on"), "vlm_thinking"),
        (~v("doc_font_pt").isin(*FONT_SIZES), "doc_font_pt"),
        (~v("doc_paper").isin(*PAPERS), "doc_paper"),
        (~v("doc_margin_in").between(0.25, 4), "doc_margin_in"),
        ((F.trim(v("output_dir")) != "") & ~v("output_dir").rlike(r"^(?:/|[A-Za-z]:[\\/])"), "output_dir"),
    ]
    return F.filter(F.array(*[F.when(bad, name) for bad, name in checks]), lambda x: x.isNotNull())


# --- prompts -----------------------------------------------------------------------------------

FIX_LIMIT = 24_000
TEXT_ONLY = "No image is attached; the text above is authoritative. Change only what the errors require.\n\n"


def fix_prompt(text: Column, errors: Column, hints: Column, repeats: Column, text_only: Column) -> Column:
    """The request to repair a page; the text's last FIX_LIMIT characters, escalated after a repeat."""
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat_ws(
        "",
        F.lit("Generated LaTeX:\n```latex\n"),
        F.right(strip(text), F.lit(FIX_LIMIT)),
        F.lit("\n```\n\nCompiler errors:\n"),
        F.when(F.size(errors) > 0, bullets(errors)).otherwise("- unknown error"),
        F.lit("\n\n"),
        F.when(F.size(hints) > 0, F.concat(F.lit("Hints:\n"), bullets(hints), F.lit("\n\n"))),
        F.when(repeats >= 1, F.concat(F.lit("IMPORTANT: "), repeats.cast("string"), F.lit(" earlier attempt(s) gave this same error: change the approach.\n\n"))),
        F.when(text_only, TEXT_ONLY),
        F.lit("Fix the errors and return the corrected full page body."),
    )


def page_prompt(context: Column, open_envs: Column, names: Column) -> Column:
    """The request to read a page; context, open environments and up to five document names if there are any."""
    return F.concat_ws(
        "\n\n",
        F.when(F.size(names) > 0, F.concat(F.lit("Document: "), F.array_join(F.slice(names, 1, 5), ", "))),
        F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context:\n"), context)),
        F.when(F.size(open_envs) > 0, F.concat(F.lit("Still open: "), F.array_join(open_envs, ", "))),
        F.lit("Transcribe the page."),
    )
