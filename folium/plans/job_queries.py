"""Queries on jobs, pages and events: conversations are jobs of pages, event users are jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text, tokens
from folium.operators import islands, jobs, sequence
from folium.plans.text_queries import B, table

PAGE = f"text || chr(10) || CASE turn % 3 WHEN 0 THEN {B} || 'begin{{proof}}' WHEN 1 THEN {B} || 'begin{{itemize}}' || {B} || 'begin{{center}}' ELSE {B} || 'end{{itemize}}' END"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(PAGE).alias("latex"))


PAGES_SQL = f"pages AS (SELECT conv_id, turn, {PAGE} AS latex FROM conversations)"


def context_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.context_tail(pages(spark, sf_dir), ["conv_id"], "turn", "latex", F.col("turn") % 4 != 1, n=3)
    return found.select("conv_id", "turn", F.array_join("context", "\n").alias("context"))


CONTEXT_SQL = f"""WITH {PAGES_SQL},
lined AS (SELECT conv_id, turn, list_filter(list_transform(string_split(latex, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> '') AS l FROM pages),
gathered AS (SELECT a.conv_id, a.turn, (SELECT flatten(list(b.l ORDER BY b.turn)) FROM lined b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.turn % 4 <> 1) AS l FROM lined a)
SELECT conv_id, turn, coalesce(list_aggregate(l[greatest(1, len(l) - 2):], 'string_agg', chr(10)), '') AS context FROM gathered"""


def open_envs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.environments_before(pages(spark, sf_dir), ["conv_id"], "turn", "latex", F.lit(True))
    return found.select("conv_id", "turn", F.array_join("open_envs", ",").alias("open_envs"))


OPEN_SQL = """WITH RECURSIVE state AS (
    SELECT conv_id, 0::BIGINT AS n, []::VARCHAR[] AS stack FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT s.conv_id, s.n + 1, CASE c.turn % 3 WHEN 0 THEN list_append(stack, 'proof') WHEN 1 THEN list_concat(stack, ['itemize', 'center'])
        ELSE CASE WHEN list_contains(stack, 'itemize') THEN stack[1:len(stack) - list_position(list_reverse(stack), 'itemize')] ELSE stack END END
    FROM state s JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) c ON c.conv_id = s.conv_id AND c.i = s.n)
SELECT c.conv_id, c.turn, coalesce(list_aggregate(stack, 'string_agg', ','), '') AS open_envs
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) c JOIN state s ON s.conv_id = c.conv_id AND s.n = c.i"""


def html_open_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3's fold with a page's elements as environments."""
    tags = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"<(div|p|b|article|nav|ul|li|footer)\b[^>]*>", r"\\begin{$1}"), r"</(div|p|b|article|nav|ul|li|footer)>", r"\\end{$1}"), r"<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tokens.open_environments(tags), ",").alias("open_elements"))


def assemble_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.documents(pages(spark, sf_dir), ["conv_id"], "turn", "latex", F.lit("\\documentclass{article}"))
    return found.select("conv_id", F.md5("tex").alias("digest"), "engine", "pages", F.col("n_closed").cast("long").alias("n_closed"))


ASSEMBLE_SQL = f"""WITH RECURSIVE {PAGES_SQL}, before AS ({OPEN_SQL.removeprefix('WITH RECURSIVE ').split('SELECT c.conv_id, c.turn')[0].split('state AS (', 1)[1].rsplit(')', 1)[0]}), 
last AS (SELECT conv_id, arg_max(stack, n) AS stack FROM before GROUP BY conv_id),
bodies AS (SELECT conv_id, trim(string_agg(latex, chr(10) || chr(10) ORDER BY turn), ' ' || chr(10) || chr(9)) AS body, count(*) AS pages FROM pages GROUP BY conv_id)
SELECT conv_id, md5('\\documentclass{{article}}' || chr(10) || '\\begin{{document}}' || chr(10) || body
    || CASE WHEN len(stack) > 0 THEN chr(10) || list_aggregate(list_transform(list_reverse(stack), lambda e: '\\end{{' || e || '}}'), 'string_agg', chr(10)) ELSE '' END
    || chr(10) || '\\end{{document}}' || chr(10)) AS digest, 'pdflatex' AS engine, pages, len(stack) AS n_closed FROM bodies JOIN last USING (conv_id)""".replace("FROM state s JOIN", "FROM before s JOIN")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.failure_streaks(events(spark, sf_dir), ["user_id"], "event_id", F.col("event_type") == "error", F.col("event_type") == "view")


def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streaks(spark, sf_dir).select("event_id", "user_id", "streak")


STREAK = """parts AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events),
streaks AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY event_id)::BIGINT AS streak FROM parts)"""


def breaker_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streaks(spark, sf_dir)
    trips = islands.breaker_trips(rows, ["user_id"], "event_id")
    return islands.after_trip(rows.select("event_id", "user_id"), trips, ["user_id"], "event_id").select("event_id", "user_id", "skipped")


TRIP_SQL = f"""WITH {STREAK}, trips AS (SELECT user_id, min(event_id) AS t FROM streaks WHERE streak >= 3 GROUP BY user_id)
SELECT event_id, user_id, coalesce(event_id > t, false) AS skipped FROM events LEFT JOIN trips USING (user_id)"""


def repeat_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.repeats(events(spark, sf_dir), ["user_id"], "event_id", "event_type").select("event_id", "user_id", "repeats")


REPEAT_SQL = """WITH marked AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events),
parts AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM marked)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, part ORDER BY event_id) - 1 AS repeats FROM parts"""


def stalled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.stalls(events(spark, sf_dir), ["user_id"], "ts", stall=3600, total=86_400)
    return found.select("user_id", "kind", F.unix_timestamp("at").alias("at"))


STALL_SQL = """WITH timed AS (SELECT user_id, ts, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS gap,
    epoch(date_trunc('second', ts))::BIGINT - min(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id) AS since FROM events),
kinds AS (SELECT user_id, ts, CASE WHEN gap > 3600 THEN 'stall' WHEN since > 86400 THEN 'total' END AS kind FROM timed)
SELECT user_id, arg_min(kind, (ts, kind)) AS kind, epoch(date_trunc('second', min(ts)))::BIGINT AS at FROM kinds WHERE kind IS NOT NULL GROUP BY user_id"""


def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.event_tail(events(spark, sf_dir), ["user_id"], "event_id", 5).select("event_id", "user_id", F.col("seq").cast("long").alias("seq"))


TAIL_SQL = """SELECT * FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) WHERE seq >= 5"""


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'click' THEN 'page_start' WHEN 'error' THEN 'engine_error' WHEN 'view' THEN 'page_done' WHEN 'signup' THEN 'job_start' ELSE 'job_done' END")
    return events(spark, sf_dir).select("event_id", jobs.event_message(kind, F.col("user_id"), F.col("event_type")).alias("message"), jobs.event_severity(kind).alias("severity"))


MESSAGE_SQL = """SELECT event_id, CASE event_type WHEN 'click' THEN 'page ' || user_id || ': reading' WHEN 'error' THEN 'page ' || user_id || ' failed: error'
    WHEN 'view' THEN 'page ' || user_id || ': view' WHEN 'signup' THEN 'job started' ELSE 'job done: ' || event_type END AS message,
    CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS severity FROM events"""


def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey AS job_id", "o_orderstatus <> 'P' AS compile_ok", "o_orderkey % 4 AS attempts", "o_orderstatus = 'F' AS autofixed")
    return sequence.page_status(rows).select("o_orderkey", "job_id", "status")


STATUS_SQL = """SELECT o_orderkey, o_custkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 4 <= 1 AND o_orderstatus <> 'F' THEN 'ok' ELSE 'fixed' END AS status FROM orders"""


def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.job_summary(page_status(spark, sf_dir), ["job_id"])


SUMMARY_SQL = f"SELECT job_id, count(*) AS pages, count(*) FILTER (status <> 'failed') AS pages_ok, bool_and(status <> 'failed') AS ok FROM ({STATUS_SQL}) GROUP BY job_id"


def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'pending' END AS status", "cast(null AS string) AS error", "timestamp'2024-01-01 00:00:00' AS updated_at")
    log = events(spark, sf_dir).select(F.col("user_id").alias("id"), "ts")
    now = log.agg(F.max("ts").cast("string")).first()[0]
    return jobs.interrupted(rows, log, F.to_timestamp(F.lit(now)), grace=86_400).select("id", "status", "error")


INTERRUPTED_SQL = """WITH last AS (SELECT user_id AS id, max(ts) AS last FROM events GROUP BY user_id), now AS (SELECT max(ts) AS now FROM events),
jobs AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'pending' END AS status FROM customer),
judged AS (SELECT id, status, status <> 'done' AND epoch(date_trunc('second', now))::BIGINT - epoch(date_trunc('second', coalesce(last, TIMESTAMP '2024-01-01')))::BIGINT >= 86400 AS dead
    FROM jobs LEFT JOIN last USING (id), now)
SELECT id, CASE WHEN dead THEN 'error' ELSE status END AS status, CASE WHEN dead THEN 'interrupted' END AS error FROM judged"""


def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.sort_array(keys), ",").alias("keys"))


PROPS_SQL = "SELECT event_id, coalesce(list_aggregate(list_sort(json_keys(props)), 'string_agg', ','), '') AS keys FROM events"


def settings_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("""struct(CASE p_partkey % 5 WHEN 0 THEN 'odd' WHEN 1 THEN 'vlm' ELSE 'hybrid' END AS engine, CASE WHEN p_partkey % 2 = 0 THEN 'http://x' END AS vlm_base_url, CASE p_partkey % 3 WHEN 0 THEN ' ' ELSE 'm' END AS vlm_model,
        cast(p_retailprice AS int) AS dpi, p_size - 5 AS max_retries, p_size AS vlm_parallel_workers, p_size AS vlm_stall_timeout, 20 AS vlm_timeout, 4 AS vlm_retries,
        'off' AS vlm_thinking, 8 + p_size % 5 AS doc_font_pt, 'a4paper' AS doc_paper, p_size / 10.0 AS doc_margin_in, CASE WHEN p_size > 40 THEN 'out' ELSE '' END AS output_dir)""")
    rows = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    return rows.select("p_partkey", F.array_join(text.settings_problems("s"), ",").alias("problems"))


SETTINGS_SQL = """SELECT p_partkey, coalesce(list_aggregate(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'engine' END, CASE WHEN p_partkey % 5 = 1 AND (p_partkey % 2 <> 0 OR p_partkey % 3 = 0) THEN 'endpoint' END,
    CASE WHEN p_retailprice::INT NOT BETWEEN 50 AND 1200 THEN 'dpi' END, CASE WHEN p_size < 5 THEN 'max_retries' END, CASE WHEN p_size NOT BETWEEN 1 AND 16 THEN 'vlm_parallel_workers' END,
    CASE WHEN p_size < 10 THEN 'vlm_stall_timeout' END, CASE WHEN 20 < p_size THEN 'vlm_timeout' END, CASE WHEN 8 + p_size % 5 NOT IN (10, 11, 12) THEN 'doc_font_pt' END,
    CASE WHEN p_size / 10.0 NOT BETWEEN 0.25 AND 4 THEN 'doc_margin_in' END, CASE WHEN p_size > 40 THEN 'output_dir' END], lambda x: x IS NOT NULL), 'string_agg', ','), '') AS problems FROM part"""


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").selectExpr("n_name AS stem", "'.pdf' AS suffix")
    taken = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    taken = taken.selectExpr("CASE c_custkey % 5 WHEN 0 THEN n_name || '.pdf' ELSE n_name || ' (' || (2 + c_custkey % 7) || ').pdf' END AS name")
    return jobs.unique_names(wanted, taken).select("stem", "name")


UNIQUE_SQL = """WITH taken AS (SELECT n_name AS stem, CASE c_custkey % 5 WHEN 0 THEN 1 ELSE 2 + c_custkey % 7 END AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
free AS (SELECT n_name AS stem, min(k) AS k FROM nation, range(1, 1000) r(k) WHERE NOT EXISTS (SELECT 1 FROM taken WHERE stem = n_name AND n = k) GROUP BY n_name)
SELECT stem, stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.pdf' AS name FROM free"""


def call_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", jobs.call_budget(F.col("p_size") % 5, F.lit(600), F.lit(2)).cast("long").alias("seconds"))


BUDGET_SQL = "SELECT p_partkey, greatest((p_size % 5 + 1) * (600 + 2 * (p_size % 5 + 1)) + 60, 900)::BIGINT AS seconds FROM part"


def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END AS status")
    return jobs.latest_jobs(rows)


LATEST_SQL = "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 9 > 0 ORDER BY o_orderkey DESC LIMIT 50"


def updated_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS status", "c_name AS error", "0L AS updated_at")
    changes = table(spark, sf_dir, "orders").selectExpr("o_custkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status", "cast(null AS string) AS error", "o_orderkey AS updated_at")
    return jobs.merged_jobs(base, changes)


UPDATED_SQL = """WITH versions AS (SELECT c_custkey AS id, c_mktsegment AS status, 0::BIGINT AS moment FROM customer
    UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT id, arg_max(status, moment) FILTER (WHERE status IS NOT NULL) AS status, any_value(c_name) AS error, max(moment) AS updated_at FROM versions JOIN customer ON c_custkey = id GROUP BY id"""

QUERIES = {
    "context_tail": context_tail, "open_envs": open_envs, "html_open_elements": html_open_elements, "assemble_document": assemble_document,
    "failure_streak": failure_streak, "breaker_trip": breaker_trip, "repeat_signature": repeat_signature, "stalled_jobs": stalled_jobs,
    "event_tail": event_tail, "event_messages": event_messages, "page_status": page_status, "job_summary": job_summary,
    "interrupted_jobs": interrupted_jobs, "props_json_extract": props_json_extract, "settings_problems": settings_problems,
    "unique_names": unique_names, "call_budgets": call_budgets, "latest_jobs": latest_jobs, "updated_jobs": updated_jobs,
}
ORACLES = {
    "context_tail": CONTEXT_SQL, "open_envs": OPEN_SQL, "assemble_document": ASSEMBLE_SQL, "failure_streak": f"WITH {STREAK} SELECT * FROM streaks",
    "breaker_trip": TRIP_SQL, "repeat_signature": REPEAT_SQL, "stalled_jobs": STALL_SQL, "event_tail": TAIL_SQL, "event_messages": MESSAGE_SQL,
    "page_status": STATUS_SQL, "job_summary": SUMMARY_SQL, "interrupted_jobs": INTERRUPTED_SQL, "props_json_extract": PROPS_SQL,
    "settings_problems": SETTINGS_SQL, "unique_names": UNIQUE_SQL, "call_budgets": BUDGET_SQL, "latest_jobs": LATEST_SQL, "updated_jobs": UPDATED_SQL,
}
