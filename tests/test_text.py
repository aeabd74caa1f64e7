import pytest
from pyspark.sql import functions as F

from folium.functions import quality, text, tokens
from folium.functions.repair import MACROS, colored, corner_rows, fitted, repaired, similar
from folium.operators import sequence


def apply(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = {
    "body": (
        text.body_only,
        {
            "\\documentclass{a}\n\\usepackage{b}\n\\begin{document}\nHi\n\\end{document}\nrest": "Hi",
            "\\usepackage[x]{b} tail\nHi $x$\n": "Hi $x$",
            "```latex\nHi\n```": "Hi",
            " \n\t\n": "",
            None: "",
            "plain": "plain",
        },
    ),
    "comment": (text.commented, {"a\n\nb": "% a\n%\n% b", "": "", "x\n": "% x", "a\r\n b": "% a\n%  b"}),
    "reply": (
        text.reply_latex,
        {
            "Sure, here you go.\n```latex\n\\frac12\n```\nbye": "\\frac12",
            "Here is the transcription of the page.\n$x$\nLet me know if you want changes.": "$x$",
            "Here is my proof of theorem 3": "Here is my proof of theorem 3",
            "```": "",
            None: "",
        },
    ),
    "indicator": (text.indicator, {"\\mathbb{1}_A \\mathbb 1 \\mathds{ 1 } \\mathbb{R}": "\\mathbbm{1}_A \\mathbbm{1} \\mathbbm{1} \\mathbb{R}"}),
    "margin": (text.margin_labels_spaced, {"\\textbf{② ab} x": "\\textbf{② ab}\\quad x", "\\textcolor{red}{\\textbf{① a}}  y": "\\textcolor{red}{\\textbf{① a}}\\quad y", "\\textbf{a} x": "\\textbf{a} x"}),
    "green": (lambda c: text.margin_labels_colored(c, "green"), {"\\textbf{① a} \\textcolor{green}{\\textbf{② b}}": "\\textcolor{green}{\\textbf{① a}} \\textcolor{green}{\\textbf{② b}}"}),
    "corner": (
        text.corner_heading,
        {
            "\\begin{wraptable}{r}{3cm}\nWords\n\\begin{tabular}{l}": "\\begin{wraptable}{r}{3cm}\nWords\\par\n\\begin{tabular}{l}",
            "\\begin{wraptable}{r}{3cm}\nWords\\par\n\\begin{tabular}{l}": "\\begin{wraptable}{r}{3cm}\nWords\\par\n\\begin{tabular}{l}",
        },
    ),
    "hash": (text.bare_hash_escaped, {"# and \\#": "\\# and \\#", "\\newcommand{\\a}[1]{#1}": "\\newcommand{\\a}[1]{#1}"}),
    "symbols": (lambda c: text.symbols_as_macros(c, MACROS), {"So p ∤ n.": "So p $\\nmid$ n.", "2 × 3": "2 × 3"}),
    "label": (
        text.label_bold,
        {
            "Thm (Hopf). Let": "\\textbf{Thm (Hopf).} Let",
            "Defined here.": "Defined here.",
            "\\textbf{Def.} x": "\\textbf{Def.} x",
            "% Def. x": "% Def. x",
            "  Lecture 9 2025/11/9 Week 12": "  \\textbf{Lecture 9 2025/11/9 Week 12}",
            "见 推论 2.2. 对 $定理 1.1$": "见 \\textbf{推论 2.2.} 对 $定理 1.1$",
            "延拓定理": "延拓定理",
        },
    ),
    "paragraphs": (
        tokens.paragraphs,
        {
            "a\nb": "a\n\nb",
            "a \\\\\nb": "a \\\\\nb",
            "\\begin{itemize}\n\\item a\n\\end{itemize}\nb": "\\begin{itemize}\n\\item a\n\\end{itemize}\n\nb",
            "\\[\na\nb\n\\]\nc": "\\[\na\nb\n\\]\n\nc",
            "$\\big($$f$\nb": "$\\big($$f$\n\nb",
            "$$\na\n$$\nb": "$$\na\n$$\n\nb",
            "": "",
        },
    ),
    "figures": (text.figures_out_of_math, {"\\[ \\figbox{1}{2}{3}{4} \\]": "\\figbox{1}{2}{3}{4} ", "$x$": "$x$"}),
    "dropped": (lambda c: text.colors_dropped(c, ["blue"]), {"\\textcolor{blue}{a \\textcolor{red}{b}} c": "a \\textcolor{red}{b} c"}),
    "signature": (text.signature, {"Bad thing (line 12)": "Bad thing"}),
    "key": (text.masked_key, {"sk-123456": "sk-1...", "": "", None: ""}),
    "stem": (lambda c: text.safe_stem(c, F.lit("notes")), {"week 3/4: charts.pdf": "week 34 charts", "../../secret.pdf": "secret", "..": "notes", "x" * 90 + ".png": "x" * 80}),
}


@pytest.mark.parametrize("name", CASES)
def test_rewrites(spark, name):
    fn, cases = CASES[name]
    assert apply(spark, cases, fn) == list(cases.values())


@pytest.mark.parametrize("name", ["body", "indicator", "margin", "green", "corner", "hash", "label", "paragraphs", "dropped"])
def test_rewrites_again_change_nothing(spark, name):
    fn, cases = CASES[name]
    assert apply(spark, cases.values(), fn) == list(cases.values())


def test_repairs():
    fixed = {
        "Hausdorff & 2nd countable, so $M$ & $N$.": ("Hausdorff \\& 2nd countable, so $M$ \\& $N$.", ["escaped 2 bare '&'"]),
        "already \\& fine % and a & in a comment\nnext": ("already \\& fine % and a & in a comment\nnext", []),
        "text \\end{proof} more": ("text  more", ["removed 1 stray \\end"]),
        "\\begin{proof}\nx": ("\\begin{proof}\nx\n\\end{proof}", ["closed 1 unclosed environment(s)"]),
        "$$\\begin{aligned} a &= b \\\\[2pt] c \\end{aligned}$$": ("$$\\begin{aligned} a &= b \\\\[2pt] c \\end{aligned}$$", []),
        "$2 × 3$ and 2 × 3": ("$2 \\times  3$ and 2 × 3", ["replaced 1 unsupported Unicode symbol(s)"]),
        "L^p and x_{12}": ("$L^p$ and $x_{12}$", ["put 2 text-mode sub/superscript(s) into math"]),
        "\\includegraphics{p0001_f1.png} \\label{a_b}": ("\\includegraphics{p0001_f1.png} \\label{a_b}", []),
        "\\[\\begin{array}{c|c} 1 & 2 & 3 \\end{array}\\]": ("\\[\\begin{array}{c|cc} 1 & 2 & 3 \\end{array}\\]", ["widened 1 array/tabular column spec(s)"]),
        "\\textcolor{red}{a {b}\n\nc}": ("{\\color{red}a {b}\n\nc}", ["turned 1 multi-paragraph \\textcolor into a \\color group"]),
    }
    for given, want in fixed.items():
        assert repaired(given) == want
        assert repaired(want[0])[0] == want[0]
    crossed = repaired("\\begin{center}\\begin{itemize}\\item a\\end{center}")[0]
    assert crossed.index("\\end{itemize}") < crossed.index("\\end{center}")
    nested = "\\begin{tabular}{l}\\begin{tabular}{l}a\\end{tabular}\\end{tabular}"
    assert fitted(nested)[0] == "\\fitpage{" + nested + "}" == fitted(fitted(nested)[0])[0]
    rows = corner_rows("\\begin{wraptable}{r}{2cm}\nWords\na \\quad b\nc & d & e\n\\end{wraptable}")[0]
    assert "Words\n\n\\begin{tabular}{lll}\na & b &  \\\\\nc & d & e \\\\\n" in rows
    assert repaired(None) == (None, [])


def test_colors():
    text = "the quick brown fox and the quick end"
    assert colored(text, [("red", "brown fox"), ("blue", "the quick"), ("green", "zzz")]) == ("\\textcolor{blue}{the quick} \\textcolor{red}{brown fox} and the quick end", 2)
    assert colored("a \\underline{word} b", [("red", "word")])[0] == "a \\textcolor{red}{\\underline{word}} b"
    assert similar("measure theory", "measure theorem") and not similar("测度", "的外测度是") and not similar("", "a")


def test_quality(spark):
    good = "\n".join("a long line of notes with $x$ in it, well over twenty-five" for _ in range(6))
    rows = spark.createDataFrame([(good, 6), (good, 12), ("", 3), ("ab cd\n" * 40, 5), ("SQL\nUL\nse", 0), (" \n" * 30 + "$x$ y", 2)], "t string, e int")
    found = [r.v.reason for r in rows.select(quality.verdict(quality.line_stats(F.col("t")), F.col("e")).alias("v")).collect()]
    assert found == ["ok", "lines skipped", "empty", "does not look like notes", "does not look like notes", "mostly white space"]
    assert quality.loop_start("\\quad " * 1000) == 2000 and quality.loop_start("short") is None
    assert quality.tail_ratio(good * 10) is not None


def test_environments(spark):
    fold = lambda c: F.array_join(tokens.open_environments(c), ",")
    cases = {
        "\\begin{a}\\begin{b}\\end{a}": "", "\\begin{a}\\begin{b}": "a,b", "\\end{z}\\begin{a}": "a", "\\begin{document}\\begin{verbatim}": "",
        "\\begin{a}\\begin{b}\\begin{a}\\end{a}": "a,b",
    }
    assert apply(spark, cases, fold) == list(cases.values())


def test_context_and_documents(spark):
    pages = spark.createDataFrame([(1, i, f"l{i}a\n\nl{i}b \n", i != 2) for i in range(1, 6)] + [(2, 1, "\\begin{proof} 中", True)], "job int, page int, latex string, ok boolean")
    got = sequence.context_tail(pages, ["job"], "page", "latex", F.col("ok"), n=3).orderBy("job", "page").collect()
    assert [r.context for r in got] == [[], ["l1a", "l1b"], ["l1a", "l1b"], ["l1b", "l3a", "l3b"], ["l3b", "l4a", "l4b"], []]
    docs = {r.job: r for r in sequence.documents(pages, ["job"], "page", "latex", F.lit("\\documentclass{article}\n")).collect()}
    assert docs[2].engine == "xelatex" and "ctex" in docs[2].tex and "\\end{proof}" in docs[2].tex and docs[1].n_closed == 0
    log = spark.createDataFrame([(1, "! Undefined control sequence.\nx\nl.12 y\n! Emergency stop.\n./a.tex:3: Missing $")], "id int, log string")
    assert [tuple(r) for r in sequence.log_errors(log, ["id"], "log").collect()] == [(1, 1, "Undefined control sequence.", 12), (1, 2, "Missing $", None)]
