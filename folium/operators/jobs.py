"""Jobs and their event logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event types and job statuses.
EVENT_TYPES = (
    "job_start", "ingested", "prefetch_start", "prefetched", "page_start", "strips_planned", "strip_retry", "strip_reread",
    "strip_done", "strip_doubtful", "strip_unreadable", "transcribed", "autofix", "compile_fail", "engine_error", "page_done",
    "job_cancelled", "job_aborted", "cancel_requested", "job_done", "job_error", "saved", "save_failed",
)
STATUSES = ("pending", "running", "done", "error", "cancelled")
TERMINAL = ("job_done", "job_error")
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif")
UPLOADS = ("pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")


def event_tail(events: DataFrame, keys: list[str], at: str, after: int) -> DataFrame:
    """Each log from its ``after``-th row on, by place in the log."""
    w = Window.partitionBy(*keys).orderBy(at)
    return events.withColumn("seq", F.row_number().over(w) - 1).where(F.col("seq") >= after)


def latest_jobs(jobs: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` latest jobs that can be read."""
    return jobs.where(F.col("status").isNotNull()).orderBy(F.desc("id")).limit(most)


def merged_jobs(jobs: DataFrame, updates: DataFrame, at: str = "updated_at") -> DataFrame:
    """Each job's fields after its updates in order: the latest value that isn't null; updates of no job do nothing."""
    fields = [c for c in jobs.columns if c not in ("id", at)]
    known = updates.join(jobs.select("id"), "id", "left_semi").unionByName(jobs, allowMissingColumns=True)
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in fields]
    return known.groupBy("id").agg(*newest, F.max(at).alias(at)).select(*jobs.columns)


def interrupted(jobs: DataFrame, events: DataFrame, now: Column, grace: int = 120) -> DataFrame:
    """``jobs`` (id, status, error, updated_at) with those that stopped without an end marked as errors.

    A job's last sign is its last event (id, ts), or its own update where it has none.
    """
    last = events.groupBy("id").agg(F.max("ts").alias("_last"))
    out = jobs.join(last, "id", "left").withColumn("_last", F.coalesce("_last", "updated_at"))
    dead = F.col("status").isin("pending", "running") & (F.unix_timestamp(now) - F.unix_timestamp(F.col("_last")) >= grace)
    return out.withColumns(
        {"status": F.when(dead, "error").otherwise(F.col("status")), "error": F.when(dead, "interrupted").otherwise(F.col("error")), "interrupted": F.coalesce(dead, F.lit(False))}
    ).drop("_last")


def stalls(events: DataFrame, keys: list[str], at: str, stall: int = 120, total: int = 600, data: Column | None = None) -> DataFrame:
    """X2 in batch: (kind, at) of each key's first silence longer than ``stall`` seconds, or its passing ``total``.

    Only rows for which ``data`` holds break a silence; the total counts from the first row.
    """
    rows = events.where(data) if data is not None else events
    w = Window.partitionBy(*keys).orderBy(at)
    second = F.unix_timestamp(F.col(at))
    timed = rows.withColumns({"_gap": second - F.lag(second).over(w), "_since": second - F.min(second).over(Window.partitionBy(*keys))})
    kind = F.when(F.col("_gap") > stall, "stall").when(F.col("_since") > total, "total")
    first = F.min(F.struct(F.col(at).alias("at"), kind.alias("kind"))).alias("first")
    return timed.withColumn("_kind", kind).where("_kind is not null").groupBy(*keys).agg(first).select(*keys, "first.kind", "first.at")


def call_budget(retries: Column, timeout: Column, backoff: Column, floor: int = 900) -> Column:
    """Seconds that a page's calls may take: every attempt at its cap with its waits, and a minute, ``floor`` at least."""
    n = retries + 1
    return F.greatest(n * (timeout + backoff * n) + 60, F.lit(floor))


def retry_plan(calls: DataFrame, retries: int = 4, backoff: float = 2.0, step: float = 0.25) -> DataFrame:
    """Each call's attempts (attempt, wait, temperature, thinking) until one is not worth repeating.

    ``calls`` has an array ``outcomes`` of struct<status,runaway,stalled>; a runaway warms the next
    attempt up, a stall turns thinking off, the wait grows with the attempt.
    """
    tried = calls.select("*", F.posexplode("outcomes").alias("i", "o")).where(F.col("i") <= retries)
    w = Window.partitionBy("call_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    again = F.col("o.status").isin(*RETRYABLE) | F.col("o.runaway") | F.col("o.stalled")
    ended = F.coalesce(F.max((~again).cast("int")).over(w), F.lit(0))
    out = tried.withColumns(
        {
            "attempt": F.col("i") + 1,
            "wait": F.when(F.col("i") > 0, F.col("i") * backoff).otherwise(0.0),
            "temperature": F.coalesce(F.sum(F.col("o.runaway").cast("int")).over(w), F.lit(0)) * step,
            "thinking": F.coalesce(F.max(F.col("o.stalled").cast("int")).over(w), F.lit(0)) == 0,
            "_ended": ended,
        }
    )
    return out.where("_ended = 0").select("call_id", "attempt", "wait", "temperature", "thinking", F.col("o.status").alias("status"))


def after_cancel(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``events`` with ``cancelled``: at or behind the request to cancel."""
    asked = events.where("type = 'cancel_requested'").groupBy(*keys).agg(F.min(at).alias("_asked"))
    return events.join(asked, keys, "left").withColumn("cancelled", F.coalesce(F.col(at) >= F.col("_asked"), F.lit(False))).drop("_asked")


def strip_seconds(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Seconds from a strip's first event to its end, one decimal."""
    began, ended = F.min(at), F.max(F.when(F.col("type") == "strip_done", F.col(at)))
    span = (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / F.lit(1e6)
    return events.groupBy(*keys).agg(F.round(span, 1).alias("seconds")).where("seconds is not null")


def event_message(kind: Column, page: Column, detail: Column) -> Column:
    """The line that a reader sees for an event."""
    name = F.concat(F.lit("page "), page.cast("string"))
    return (
        F.when(kind == "job_start", "job started")
        .when(kind == "ingested", F.concat(detail, F.lit(" page(s) ingested")))
        .when(kind == "page_start", F.concat(name, F.lit(": reading")))
        .when(kind == "page_done", F.concat(name, F.lit(": "), detail))
        .when(kind.isin("compile_fail", "engine_error"), F.concat(name, F.lit(" failed: "), detail))
        .when(kind.isin(*TERMINAL), F.concat_ws(": ", F.replace(kind, F.lit("_"), F.lit(" ")), detail))
        .otherwise(F.concat_ws(" ", F.replace(kind, F.lit("_"), F.lit(" ")), detail))
    )


def event_severity(kind: Column) -> Column:
    bad, odd = ("job_error", "engine_error", "save_failed"), ("compile_fail", "strip_doubtful", "strip_unreadable", "job_cancelled", "job_aborted")
    return F.when(kind.isin(*bad), "error").when(kind.isin(*odd), "warning").otherwise("info")


def replies(lines: DataFrame, keys: list[str], at: str, line: str = "line") -> DataFrame:
    """(content, reasoning, done, finished, n_data, n_pings) of streamed replies, chunks in order; bad lines are skipped."""
    chunk = "struct<choices:array<struct<delta:struct<content:string,reasoning_content:string>,finish_reason:string>>>"
    body = F.regexp_extract(line, r"^data:\s*(.*)$", 1)
    parsed = lines.withColumns({"_c": F.from_json(F.when(body != "[DONE]", body), chunk), "_done": body == "[DONE]", "_ping": F.col(line).startswith(":")})
    text = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.coalesce(F.col(f"_c.choices")[0]["delta"][f], F.lit("")).alias("t")))), lambda s: s["t"]), "")
    return parsed.groupBy(*keys).agg(
        text("content").alias("content"), text("reasoning_content").alias("reasoning"), F.bool_or("_done").alias("done"),
        F.coalesce(F.bool_or(F.col("_c.choices")[0]["finish_reason"].isNotNull()), F.lit(False)).alias("finished"),
        F.count_if(body != "").alias("n_data"), F.count_if("_ping").alias("n_pings"),
    )


def unique_names(wanted: DataFrame, taken: DataFrame, most: int = 999) -> DataFrame:
    """For each (stem, suffix) the first of ``stem.suffix``, ``stem (2).suffix`` ... that ``taken`` (name) lacks.

    Taken names of a stem are numbered, so a stem gives as many rows as it has names, not ``most``.
    """
    name = F.regexp_extract("name", r"^(.*?)(?: \((\d+)\))?(\.[^.]*)?$", 1)
    n = F.coalesce(F.expr(r"try_cast(regexp_extract(name, '^(.*?)(?: \\((\\d+)\\))?(\\.[^.]*)?$', 2) as int)"), F.lit(1))
    used = taken.select(name.alias("stem"), F.regexp_extract("name", r"(\.[^.]*)?$", 0).alias("suffix"), n.alias("n")).distinct()
    sets = used.groupBy("stem", "suffix").agg(F.collect_set("n").alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.least(F.size("used") + 1, F.lit(most))), F.col("used")))
    k = F.coalesce(F.when(F.col("used").isNotNull(), free), F.lit(1))
    return wanted.join(sets, ["stem", "suffix"], "left").select(
        "stem", "suffix", F.when(k == 1, F.concat("stem", "suffix")).otherwise(F.concat(F.col("stem"), F.lit(" ("), k.cast("string"), F.lit(")"), F.col("suffix"))).alias("name")
    )


def upload_ok(name: Column, allowed: tuple[str, ...] = UPLOADS) -> Column:
    """F17"""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*allowed)


# Suffixes of files that a compiler leaves behind.
LEFT_BEHIND = (
    "aux", "log", "out", "toc", "lof", "lot", "fls", "fdb_latexmk", "synctex.gz", "bbl", "blg", "bcf", "run.xml", "idx", "ilg",
    "ind", "nav", "snm", "vrb", "xdv", "thm", "loe", "acn", "acr", "alg", "glo",
)


def left_behind(path: Column) -> Column:
    """Whether a file is one that a clean-up deletes."""
    return path.rlike(r"\.(?:" + "|".join(x.replace(".", r"\.") for x in LEFT_BEHIND) + r")$") | path.rlike(r"(?:^|/)_minted-[^/]*/")
