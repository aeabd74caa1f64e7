"""Queries on transcripts. The driver's texts hold no markup, so it is put into them by an expression both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import quality, repair, text, tokens
from folium.operators import matching, sequence

B = "chr(92)"  # a backslash, spelled alike in both engines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, name: str = "latex", source: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, source).select(key, F.expr(sql).alias(name))


def over(sql: str, body: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"WITH d AS (SELECT {key}, {sql} AS latex FROM {source}) {body}"


# --- quality ------------------------------------------------------------------------------------


def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("stats", quality.line_stats(F.col("text")))
    rows = rows.withColumn("v", quality.verdict(F.col("stats"), (F.col("doc_id") % 12).cast("int")))
    return rows.select("doc_id", F.col("stats.n").cast("long").alias("n"), F.round("stats.blank", 9).alias("blank"), "v.ok", "v.score", "v.reason")


QUALITY_SQL = r"""
WITH parts AS (
    SELECT doc_id, text, doc_id % 12 AS expected,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s]')
               AND NOT regexp_matches(x, '^\s*(?:\\textcolor\{[^}]*\}\{)?\\textbf\{[^{}]{0,12}\}\}?\s*$')
               AND NOT regexp_matches(x, '^\s*(?:\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})*|\\hline|\\centering|\\\\|\\par)\s*$')) AS lines
    FROM documents
), stats AS (
    SELECT doc_id, expected, len(lines) AS n, length(list_aggregate(lines, 'string_agg', '')) AS chars,
           len(regexp_extract_all(text, '\s'))::DOUBLE / greatest(length(text), 1) AS blank,
           len(list_filter(lines, lambda x: contains(x, '$') OR contains(x, '\')
               OR len(regexp_extract_all(x, '[\x{3400}-\x{9fff}]')) >= 2))::DOUBLE / nullif(len(lines), 0) AS rich
    FROM parts
), judged AS (
    SELECT *, chars::DOUBLE / nullif(n, 0) AS mean_length,
           CASE WHEN expected > 0 THEN least(n, expected) ELSE n END::DOUBLE AS full_score
    FROM stats
), reasoned AS (
    SELECT *, CASE WHEN n = 0 OR coalesce(chars, 0) = 0 THEN 'empty' WHEN blank > 0.45 THEN 'mostly white space'
                   WHEN rich < 0.3 AND mean_length < 40 OR expected >= 4 AND mean_length < 25 THEN 'does not look like notes'
                   WHEN expected >= 4 AND n > 3 * expected + 6 THEN 'too many lines'
                   WHEN expected >= 5 AND n < 0.85 * expected THEN 'lines skipped' ELSE 'ok' END AS reason
    FROM judged
)
SELECT doc_id, n, round(blank, 9) AS blank, reason = 'ok' AS ok,
       CASE WHEN reason IN ('ok', 'lines skipped') THEN full_score ELSE 0.0::DOUBLE END AS score, reason
FROM reasoned
"""


def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", quality.repetition_ratio("text").alias("ratio"), quality.stopped_at("text").alias("stopped_at"))


# --- whole replies -------------------------------------------------------------------------------

WHOLE = f"""CASE doc_id % 4
    WHEN 0 THEN {B} || 'documentclass{{article}}' || chr(10) || {B} || 'begin{{document}}' || chr(10) || text || chr(10) || {B} || 'end{{document}}' || chr(10) || 'after'
    WHEN 1 THEN {B} || 'usepackage{{x}} more' || chr(10) || text || chr(10) || chr(10)
    WHEN 2 THEN '```latex' || chr(10) || text || chr(10) || '```'
    ELSE '   ' || chr(10) || ' ' END"""


def sanitize_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, WHOLE).select("doc_id", text.body_only(F.col("latex")).alias("body"))


SANITIZE_SQL = over(
    WHOLE,
    rf"""
, cut AS (SELECT doc_id, CASE WHEN strpos(latex, {B} || 'begin{{document}}') > 0
              THEN substr(latex, strpos(latex, {B} || 'begin{{document}}') + 16) ELSE latex END AS t FROM d),
ended AS (SELECT doc_id, CASE WHEN strpos(t, {B} || 'end{{document}}') > 0
              THEN substr(t, 1, strpos(t, {B} || 'end{{document}}') - 1) ELSE t END AS t FROM cut),
bare AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^[ \t]*\\(?:documentclass|usepackage|RequirePackage|pgfplotsset)\b[^\n]*\n?', '', 'g'),
              '(?m)^```[a-zA-Z]*[ \t]*\n?', '', 'g') AS t FROM ended)
SELECT doc_id, CASE WHEN regexp_matches(t, '\S') THEN regexp_replace(regexp_replace(t, '^\n+', ''), '\s+$', '') ELSE '' END AS body FROM bare""",
)


def comment_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.commented(F.col("text")).alias("commented"))


COMMENT_SQL = r"""
SELECT doc_id, list_aggregate(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)),
           lambda x: CASE WHEN regexp_matches(x, '\S') THEN '% ' || x ELSE '%' END), 'string_agg', chr(10)) AS commented
FROM documents"""

REPLY = "'Here is the transcription of the page.' || chr(10) || text || chr(10) || 'Let me know if you want changes.'"


def strip_chatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(REPLY).alias("reply"))
    return rows.select("conv_id", "turn", text.without_chatter(F.col("reply")).alias("latex"))


CHATTER_SQL = (
    r"""
WITH RECURSIVE lined AS (SELECT conv_id, turn, string_split(regexp_replace("""
    + REPLY
    + r""", '\n$', ''), chr(10)) AS lines FROM conversations),
flagged AS (SELECT conv_id, turn, lines, list_filter(range(1, len(lines) + 1), lambda i: NOT (
    regexp_matches(trim(lines[i], ' ' || chr(9)), '(?i)^(?:here (?:is|''s) (?:the |a |your )?(?:transcription|latex|output|corrected|updated|revised|full|page).{0,60}[.:]?|below (?:is|are) (?:the |a |your )?(?:transcription|latex|output|corrected|updated|table|tabular|page).{0,60}[.:]?|(?:transcription|latex|output|the page|the table)\s*[:.]|sure[!,.].{0,70}|certainly[!,.].{0,70}|i (?:will|''ll|have) (?:now )?(?:transcribed|extracted|read|fixed|corrected).{0,60}[.:]?|let me know [a-z0-9 ,.''-]{0,60}[.:]?|hope (?:this|that) helps[.!]?)$')
    AND NOT contains(lines[i], chr(92)) AND NOT regexp_matches(lines[i], '[\x{3400}-\x{9fff}]'))) AS rest FROM lined)
SELECT conv_id, turn, CASE WHEN len(rest) = 0 THEN '' ELSE regexp_replace(regexp_replace(
    list_aggregate(lines[list_min(rest):list_max(rest)], 'string_agg', chr(10)), '^\s+', ''), '\s+$', '') END AS latex FROM flagged"""
)

FENCED = "'Some words first' || chr(10) || '```latex' || chr(10) || text || chr(10) || '```' || chr(10) || 'and after'"


def extract_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FENCED).select("doc_id", F.md5(text.reply_latex(F.col("latex"))).alias("digest"))


EXTRACT_SQL = r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS digest FROM documents"""

# --- signs ---------------------------------------------------------------------------------------

ONES = f"text || ' ' || {B} || 'mathbb{{1}}_A + ' || {B} || 'mathds 1 + ' || {B} || 'mathbb{{ 1 }} + ' || {B} || 'mathbb{{R}}'"


def fix_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, ONES)
    return rows.select("doc_id", text.indicator(F.col("latex")).alias("latex"), text.indicator_count(F.col("latex")).cast("long").alias("n"))


INDICATOR_SQL = over(
    ONES,
    r"""SELECT doc_id, regexp_replace(latex, '\\math(?:bb|ds)\s*(?:\{\s*1\s*\}|1)', '\\mathbbm{1}', 'g') AS latex,
    len(regexp_extract_all(latex, '\\math(?:bb|ds)\s*(?:\{\s*1\s*\}|1)'))::BIGINT AS n FROM d""",
)



def space_margin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\\textbf{①" + " a} "), "text").alias("latex"))
    return rows.select("doc_id", F.md5(text.margin_labels_spaced(F.col("latex"))).alias("digest"))


MARGIN_SQL = r"""SELECT doc_id, md5(regexp_replace('\textbf{① a} ' || text, '((?:\\textcolor\{\w+\}\{)?\\textbf\{[\x{2460}-\x{2473}\x{24f5}-\x{24fe}][^{}\n]{0,12}\}\}?)[ \t]+(\S)', '\1\\quad \2', 'g')) AS digest FROM documents"""


#: Text with escapes, a comment and math before it, so that the signs are met everywhere.
SIGNS = r"concat('a \\\\& b \\& c \\# d % e & f # the', chr(10), '$x the y$ of $$of$$ the ', text)"
SIGNS_SQL = r"concat('a \\& b \& c \# d % e & f # the', chr(10), '$x the y$ of $$of$$ the ', text)"


def escape_amp_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("latex", F.expr(SIGNS))
    return rows.select("doc_id", F.md5(text.bare_hash_escaped(text.bare_ampersand_escaped(F.col("latex")))).alias("digest"))


AMP_SQL = rf"""WITH t AS (SELECT doc_id, regexp_extract_all({SIGNS_SQL}, '(?s)\\.|\\|%[^\n]*|[&#]|[^\\%&#]+') AS w FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(w, lambda x: CASE WHEN x IN ('&', '#') THEN chr(92) || x ELSE x END), '')) AS digest FROM t"""


def unicode_to_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("latex", F.expr(SIGNS))
    rows = rows.withColumn("latex", F.replace(F.replace("latex", F.lit("the"), F.lit("∀")), F.lit("of"), F.lit("∈")))
    return rows.select("doc_id", F.md5(text.symbols_as_macros(F.col("latex"), repair.MACROS)).alias("digest"))


MACRO_SQL = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(replace(replace({SIGNS_SQL}, 'the', '∀'), 'of', '∈'), '(?s)\\.|\\|%[^\n]*|\$\$?|[^\\%$]+') AS w FROM documents),
pieces AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
modes AS (SELECT *, sum(CASE WHEN x IN ('$', '$$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS math FROM pieces)
SELECT doc_id, md5(string_agg(CASE WHEN x[1] IN ('%', '$', chr(92)) THEN x WHEN math THEN replace(replace(x, '∀', '\forall '), '∈', '\in ')
    ELSE replace(replace(x, '∀', '$\forall$'), '∈', '$\in$') END, '' ORDER BY i)) AS digest FROM modes GROUP BY doc_id"""

LABELS = "concat('Thm (a b).', ' ', replace(text, '$$', ''), chr(10), 'Defined here', chr(10), 'Proof: ', lang, chr(10), 'Lecture 3, Week 2')"


def bold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.bold_labels(derived(spark, sf_dir, LABELS), ["doc_id"], "latex")
    return rows.select("doc_id", F.md5("latex").alias("digest"))


BOLD_SQL = over(
    LABELS,
    r"""SELECT doc_id, md5(list_aggregate(list_transform(string_split(latex, chr(10)), lambda x:
    CASE WHEN regexp_matches(x, '(?i)^[ \t]*Lecture\s*\d+[^\n\\{}$]*?(?:Week\s*\d+|\d{4}[-/]?\d{1,2}[-/]?\d{1,2})[ \t]*\.?\s*$')
         THEN regexp_replace(x, '(?i)^([ \t]*)(Lecture\s*\d+[^\n\\{}$]*?(?:Week\s*\d+|\d{4}[-/]?\d{1,2}[-/]?\d{1,2}))([ \t]*\.?)\s*$', '\1\\textbf{\2}\3')
         ELSE regexp_replace(x, '^([ \t]*)((?:"""
    + "|".join(text.LABELS)
    + r""")(?:\s*\([^()\n]{0,60}\))?\s*[.:])', '\1\\textbf{\2}') END), 'string_agg', chr(10))) AS digest FROM d""",
)


def lines_as_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tokens.paragraphs(F.col("text"))).alias("digest"))


PARAGRAPH_SQL = r"""
WITH lined AS (SELECT doc_id, string_split(replace(text, '$', ''), chr(10)) AS l FROM documents),
marked AS (SELECT doc_id, list_transform(range(1, len(l) + 1), lambda i: l[i] || CASE WHEN i < len(l) AND trim(l[i]) <> '' AND trim(l[i + 1]) <> ''
    AND NOT regexp_matches(l[i + 1], '^\s*&') THEN chr(10) ELSE '' END) AS l FROM lined)
SELECT doc_id, md5(list_aggregate(l, 'string_agg', chr(10))) AS digest FROM marked"""


def lines_as_paragraphs_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "replace(text, '$', '')")
    return rows.select("doc_id", F.md5(tokens.paragraphs(F.col("latex"))).alias("digest"))


FAULTY = f"text || chr(10) || {B} || 'begin{{proof}}' || chr(10) || 'a_1 & b # c' || chr(10) || {B} || 'begin{{array}}{{cc}} 1 & 2 & 3 ' || {B} || 'end{{array}}'"


def autofix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, FAULTY).withColumn("f", repair.autofix("latex"))
    return rows.select("doc_id", F.md5("f.text").alias("digest"), F.array_join("f.changes", "; ").alias("changes"))


# --- colours --------------------------------------------------------------------------------------

COLORED = f"{B} || 'textcolor{{' || CASE doc_id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'teal' ELSE 'gray' END || '}}{{' || lang || ' ' || source || '}} and ' || {B} || 'textcolor{{blue}}{{' || {B} || 'underline{{' || source || '}}}} ' || {B} || 'textcolor{{red}}{{a}}'"


def color_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, COLORED).select("doc_id", F.posexplode(text.color_runs(F.col("latex"))).alias("run", "r"))
    return rows.select("doc_id", F.col("run").cast("long").alias("run"), "r.color", "r.plain")


RUNS_SQL = over(
    COLORED,
    r""", found AS (SELECT doc_id, regexp_extract_all(latex, '\\textcolor\{(\w+)\}\{((?:[^{}]|\{[^{}]*\})*)\}', 1) AS c,
    list_transform(regexp_extract_all(latex, '\\textcolor\{(\w+)\}\{((?:[^{}]|\{[^{}]*\})*)\}', 2),
        lambda x: trim(regexp_replace(regexp_replace(x, '\\[A-Za-z]+', ' ', 'g'), '[{}\s]+', ' ', 'g'))) AS p FROM d),
long AS (SELECT doc_id, list_filter(list_transform(range(1, len(c) + 1), lambda i: {'color': c[i], 'plain': p[i]}), lambda r: length(r.plain) >= 3) AS runs FROM found)
SELECT doc_id, generate_subscripts(runs, 1)::BIGINT - 1 AS run, unnest(runs).color AS color, unnest(runs).plain AS plain FROM long""",
)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color_runs(spark, sf_dir)


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    return rows.select("doc_id", F.lit("red").alias("color"), F.when(F.col("doc_id") % 4 == 0, F.concat_ws(" ", "lang", "source")).alias("plain"))


def reconcile_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.refuted_runs(_runs(spark, sf_dir), _reads(spark, sf_dir), ["doc_id"], exact=True)
    return found.select("doc_id", "run", "color", "refuted")


RECONCILE_SQL = (
    "WITH runs AS ("
    + RUNS_SQL
    + """), reads AS (SELECT doc_id, 'red' AS color, CASE WHEN doc_id % 4 = 0 THEN lang || ' ' || source END AS plain FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, run, color, EXISTS (SELECT 1 FROM reads WHERE reads.doc_id = runs.doc_id AND reads.color = runs.color)
    AND NOT EXISTS (SELECT 1 FROM reads WHERE reads.doc_id = runs.doc_id AND reads.color = runs.color AND reads.plain = runs.plain) AS refuted FROM runs"""
)


def reconcile_colors_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.refuted_runs(_runs(spark, sf_dir), _reads(spark, sf_dir), ["doc_id"]).select("doc_id", "run", "color", "refuted")


def drop_absent_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.absent_runs(_runs(spark, sf_dir), F.array(F.lit("red"), F.lit("pink")))
    return found.select("doc_id", "run", "color", "absent")


ABSENT_SQL = "WITH runs AS (" + RUNS_SQL + ") SELECT doc_id, run, color, color IN ('teal', 'blue') AS absent FROM runs"


def place_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", r"\s+")
    runs = F.array(F.struct(F.lit("red").alias("color"), F.array_join(F.slice(words, 2, 4), " ").alias("plain")), F.struct(F.lit("blue").alias("color"), F.get(words, 0).alias("plain")))
    rows = table(spark, sf_dir, "documents").withColumn("r", repair.color_text("text", runs))
    return rows.select("doc_id", F.md5("r.text").alias("digest"), F.col("r.n").cast("long").alias("n"))


# --- errors ---------------------------------------------------------------------------------------

ERROR = """CASE event_type WHEN 'error' THEN 'Undefined control sequence (line ' || event_id || ')' WHEN 'click' THEN 'Missing $ inserted'
    WHEN 'view' THEN 'Environment foo undefined' WHEN 'signup' THEN 'macro parameter character #' ELSE 'other' END"""


def error_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(ERROR).alias("e"))
    return rows.select("event_id", F.array_join(matching.error_hints(F.array("e", F.lit("Undefined control sequence"))), ",").alias("hints"), text.signature(F.col("e")).alias("signature"))


HINTS_SQL = (
    r"""SELECT event_id, CASE e WHEN 'Missing $ inserted' THEN 'math mode,macro' WHEN 'Environment foo undefined' THEN 'environment,macro'
    WHEN 'macro parameter character #' THEN 'hash,macro' ELSE 'macro' END AS hints, regexp_replace(e, '\s*\(line \d+\)', '', 'g') AS signature FROM (SELECT event_id, """
    + ERROR
    + " AS e FROM events)"
)

LOG = "'! LaTeX Error: ' || event_type || '.' || chr(10) || 'x' || chr(10) || 'l.' || event_id || ' y' || chr(10) || '! Emergency stop.' || chr(10) || './a.tex:3: Missing number'"


def parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(LOG).alias("log"))
    found = sequence.log_errors(rows, ["event_id"], "log")
    return found.select("event_id", F.col("n").cast("long").alias("n"), "message", "line")


LOG_SQL = """SELECT event_id, 1::BIGINT AS n, 'LaTeX Error: ' || event_type || '.' AS message, event_id::INT AS line FROM events
UNION ALL SELECT event_id, 2::BIGINT, 'Missing number', NULL FROM events"""

# --- names ----------------------------------------------------------------------------------------


def safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_stem(F.concat("url", F.lit(".pdf")), F.lit("notes")).alias("stem"))


STEM_SQL = r"""SELECT page_id, substr(coalesce(nullif(trim(regexp_replace(regexp_replace(url || '.pdf', '[<>:"/\\|?*\x00-\x1f]+', '', 'g'), '\.[^.]+$', ''), ' .'), ''), 'notes'), 1, 80) AS stem FROM pages"""

PREAMBLE = f"{B} || 'documentclass{{article}}' || chr(10) || CASE doc_id % 3 WHEN 0 THEN {B} || 'usepackage{{ctex}}' ELSE {B} || 'usepackage{{amsmath}}' END"


def add_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PREAMBLE).select("doc_id", F.md5(text.with_cjk(F.col("latex"))).alias("digest"))


ADD_CJK_SQL = over(
    PREAMBLE,
    "SELECT doc_id, md5(CASE WHEN contains(latex, 'ctex') THEN latex ELSE replace(latex, '{article}' || chr(10), '{article}' || chr(10) || '"
    + text.CJK_PACKAGE.replace("'", "''")
    + "' || chr(10)) END) AS digest FROM d",
)


def page_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    ask = text.fix_prompt(F.col("text"), F.array("lang"), none, (F.col("doc_id") % 2).cast("int"), F.col("doc_id") % 3 == 0)
    return rows.select("doc_id", F.md5(ask).alias("digest"), F.md5(text.page_prompt(F.col("source"), none, F.array("lang"))).alias("page_digest"))


PROMPT_SQL = r"""SELECT doc_id, md5('Generated LaTeX:' || chr(10) || '```latex' || chr(10) || right(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), 24000)
    || chr(10) || '```' || chr(10) || chr(10) || 'Compiler errors:' || chr(10) || '- ' || lang || chr(10) || chr(10)
    || CASE WHEN doc_id % 2 = 1 THEN 'IMPORTANT: 1 earlier attempt(s) gave this same error: change the approach.' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN doc_id % 3 = 0 THEN 'No image is attached; the text above is authoritative. Change only what the errors require.' || chr(10) || chr(10) ELSE '' END
    || 'Fix the errors and return the corrected full page body.') AS digest,
    md5('Document: ' || lang || chr(10) || chr(10) || 'Context:' || chr(10) || source || chr(10) || chr(10) || 'Transcribe the page.') AS page_digest FROM documents"""

CORNER = (
    f"'Notes ' || doc_id || chr(10) || chr(10) || 'body' || chr(10) || ' ' || chr(10) || 'of it' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '' "
    f"ELSE {B} || 'begin{{wraptable}}{{r}}{{4cm}}' || chr(10) || chr(10) || 'a & ' || doc_id || chr(10) || {B} || 'end{{wraptable}}' END "
    f"|| CASE WHEN doc_id % 4 = 2 THEN chr(10) || chr(10) || {B} || 'begin{{wraptable}}{{l}}{{2cm}}x' || {B} || 'end{{wraptable}}' ELSE ' after' END"
)


def corner_table_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(CORNER).alias("latex"))
    return rows.select("doc_id", text.table_after_title(F.col("latex")).alias("latex"))


CORNER_UP_SQL = over(
    CORNER,
    r"""SELECT doc_id, CASE WHEN t = '' THEN latex ELSE array_to_string(list_concat([blocks[1], t], blocks[2:]), chr(10) || chr(10)) END AS latex FROM (
    SELECT *, list_filter(regexp_split_to_array(regexp_replace(replace(latex, t, ''), '^\s+|\s+$', '', 'g'), '\n\s*\n'), lambda b: regexp_matches(b, '\S')) AS blocks
    FROM (SELECT *, regexp_extract(latex, '\\begin\{wraptable\}\{[^}]*\}\{[^}]*\}.*?\\end\{wraptable\}', 0, 's') AS t FROM d))""",
)

QUERIES = {
    "wraptable_after_title": corner_table_up,
    "quality_verdict": quality_verdict, "repetition_ratio": repetition, "sanitize_body": sanitize_body, "comment_out": comment_out,
    "strip_chatter": strip_chatter, "extract_latex": extract_latex, "fix_indicator": fix_indicator, "space_margin_labels": space_margin_labels,
    "escape_amp_hash": escape_amp_hash, "unicode_to_macro": unicode_to_macro, "bold_labels": bold_labels,
    "lines_as_paragraphs": lines_as_paragraphs_plain, "lines_as_paragraphs_math": lines_as_paragraphs, "autofix": autofix,
    "color_runs": color_runs, "reconcile_colors": reconcile_colors, "reconcile_colors_fuzzy": reconcile_colors_fuzzy,
    "drop_absent_colors": drop_absent_colors, "place_colors": place_colors, "error_hints": error_hints, "parse_log": parse_log,
    "safe_stem": safe_stem, "add_cjk": add_cjk, "page_prompts": page_prompts,
}
ORACLES = {
    "wraptable_after_title": CORNER_UP_SQL,
    "quality_verdict": QUALITY_SQL, "sanitize_body": SANITIZE_SQL, "comment_out": COMMENT_SQL, "strip_chatter": CHATTER_SQL,
    "extract_latex": EXTRACT_SQL, "fix_indicator": INDICATOR_SQL, "space_margin_labels": MARGIN_SQL, "escape_amp_hash": AMP_SQL,
    "unicode_to_macro": MACRO_SQL, "bold_labels": BOLD_SQL, "lines_as_paragraphs": PARAGRAPH_SQL, "color_runs": RUNS_SQL,
    "reconcile_colors": RECONCILE_SQL, "drop_absent_colors": ABSENT_SQL, "error_hints": HINTS_SQL, "parse_log": LOG_SQL,
    "safe_stem": STEM_SQL, "add_cjk": ADD_CJK_SQL, "page_prompts": PROMPT_SQL,
}
