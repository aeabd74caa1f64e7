import json

import pytest
from pyspark.sql import functions as F

from folium.functions import plugins
from folium.operators import jobs
from folium.plans import pipeline
from folium.sources import tables
from folium.streaming import events


def test_job_records(spark, tmp_path):
    for name, body in (("a", {"id": "a", "status": "done", "filenames": ["x.pdf"], "extra": 1}), ("b", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(body if isinstance(body, str) else json.dumps(body, indent=2))
    got = tables.read_jobs(spark, f"file://{tmp_path}").collect()
    assert [(r.id, r.status, r.filenames) for r in got] == [("a", "done", ["x.pdf"])]
    made = tables.new_jobs(spark.createDataFrame([(["n.pdf"],)], "filenames array<string>"), F.lit("2025-01-02 03:04:05").cast("timestamp"), F.lit("abc123")).first()
    assert made.id == "20250102-030405-abc123" and made.status == "pending"


def test_event_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("j", "job_start", 1.0), ("j", "page_done", 2.0), ("j", "job_done", 3.0)], "job_id string, type string, ts double")
    tables.append_events(rows.coalesce(1), path)
    got = tables.read_events(spark, path, after=1).orderBy("seq").collect()
    assert [(r.seq, r.type) for r in got] == [(1, "page_done"), (2, "job_done")]


def test_documents_are_written(spark, tmp_path):
    docs = spark.createDataFrame([("j1", "a\nb"), ("j2", "c")], "job_id string, tex string")
    tables.write_documents(docs, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").where("job_id = 'j1'").count() == 2
    done = tables.compile_documents(docs, plugins.StructureCompiler()).collect()
    assert all(r.ok for r in done)


def test_pictures(spark, tmp_path):
    from tests.test_layout import blank, png

    for n in ("b.png", "a.png"):
        (tmp_path / n).write_bytes(png(blank(8, 6)))
    got = tables.read_images(spark, f"file://{tmp_path}").orderBy("page_index").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.png", "b.png"] and got[0].image.width == 6
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(Exception, match="unsupported picture"):
        tables.read_images(spark, f"file://{tmp_path}").collect()


def test_transcript_source(spark, tmp_path):
    (tmp_path / "job_1_2.tex").write_text("hello")
    spark.dataSource.register(tables.TranscriptSource)
    got = spark.read.format("transcript").option("path", str(tmp_path)).load().collect()
    assert [tuple(r) for r in got] == [("job_1", 2, "hello")]


def test_updates_and_interruptions(spark):
    base = spark.createDataFrame([("a", "pending", None, 0), ("b", "running", None, 0)], "id string, status string, error string, updated_at int")
    changes = spark.createDataFrame([("a", "running", None, 1), ("a", None, "bad", 2), ("z", "done", None, 3)], "id string, status string, error string, updated_at int")
    assert sorted(map(tuple, jobs.merged_jobs(base, changes).collect())) == [("a", "running", "bad", 2), ("b", "running", None, 0)]


def test_replies(spark):
    lines = ['data: {"choices":[{"delta":{"content":"He"}}]}', ": ping", 'data: {"choices":[{"delta":{"content":"llo"},"finish_reason":"stop"}]}', "data: {bad", "data: [DONE]"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "conn int, t int, line string")
    got = jobs.replies(rows, ["conn"], "t").first()
    assert (got.content, got.done, got.finished, got.n_pings) == ("Hello", True, True, 1)


def test_retries(spark):
    calls = spark.createDataFrame([(1, [(503, False, False), (200, True, False), (200, False, True), (200, False, False), (200, False, False)])], "call_id int, outcomes array<struct<status:int,runaway:boolean,stalled:boolean>>")
    got = [tuple(r) for r in jobs.retry_plan(calls).orderBy("attempt").collect()]
    assert got == [(1, 1, 0.0, 0.0, True, 503), (1, 2, 2.0, 0.0, True, 200), (1, 3, 4.0, 0.25, True, 200), (1, 4, 6.0, 0.25, False, 200)]


def test_transcription(spark):
    class Engine:
        name = "fake"

        def transcribe(self, page, context, open_envs, guidance=None):
            if page["page_index"] == 3:
                raise RuntimeError("dead")
            return ["a & b", "```latex\nDef. fine\n```", "", "}{ broken }"][page["page_index"] - 1]

    rows = spark.createDataFrame([("j", i) for i in range(1, 5)], "job string, page_index int")
    outcome, docs = pipeline.transcribed(rows, Engine(), plugins.StructureCompiler(), ["job"], "\\documentclass{article}\n")
    got = {r.page_index: r for r in outcome.collect()}
    assert [got[i].status for i in range(1, 5)] == ["fixed", "ok", "failed", "failed"]
    assert got[1].latex == "a \\& b" and got[2].latex == "\\textbf{Def.} fine" and got[3].error == "dead"
    tex = docs.first().tex
    assert "a \\& b" in tex and "% }{ broken }" in tex


def test_engines(spark):
    primary, fixer = plugins.engines_for("hybrid")
    assert fixer is None and plugins.capabilities(primary) == []
    page = {"page_index": 1, "regions": [{"kind": "math"}, {"kind": "text"}]}
    assert "equation*" in primary.transcribe(page, "", []) and "equation*" not in primary.transcribe(page, "", [], "fix")
    plugins.register_sql(spark)
    assert spark.sql("SELECT autofix('a & b').text AS t").first().t == "a \\& b"
    assert [r.token for r in spark.sql("SELECT * FROM latex_tokens('\\\\\\\\alpha {x}')").collect()][-1] == "}"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, f"2025-01-01 00:{m:02d}:00") for m in (0, 1, 2, 9, 10)] + [(2, "2025-01-01 00:00:00")], "job int, ts string")
    rows = rows.select("job", F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, rows.schema, f"{tmp_path}/in")
    got = events.run_once(events.stalls(stream, "job"), "stalls").where("kind <> 'silent'").collect()
    assert [(r.job, r.kind) for r in got] == [(1, "stall")]
    want = jobs.stalls(rows, ["job"], "ts").select("job", "kind", F.unix_timestamp("at").alias("at")).collect()
    assert list(map(tuple, got)) == list(map(tuple, want))
    pieces = spark.createDataFrame([(1, i, "\\quad " * 20) for i in range(60)] + [(2, i, f"line {i * i} of varied text {i}\n") for i in range(60)], "conn int, seq int, piece string")
    pieces.coalesce(1).write.parquet(f"{tmp_path}/pieces")
    stream = spark.readStream.schema(pieces.schema).parquet(f"{tmp_path}/pieces")
    assert [(r.conn, r.reason) for r in events.run_once(events.runaways(stream, "conn"), "runaways").collect()] == [(1, "repetition")]
