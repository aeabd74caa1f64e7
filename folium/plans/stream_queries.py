"""Queries that run a stream over the event table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.plans.job_queries import STALL_SQL
from folium.streaming import events


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return events.read_stream(spark, spark.read.parquet(path).schema, f"{sf_dir}/event[s].parquet")


def stream_event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "job_done").otherwise(F.col("event_type"))
    rows = events.terminal(_stream(spark, sf_dir).withColumn("type", kind)).select("event_id", "user_id", "type", "ended")
    return events.run_once(rows, "tail")


TAIL_SQL = "SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'job_done' ELSE event_type END AS type, event_type = 'purchase' AS ended FROM events"


def stream_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.run_once(events.stalls(_stream(spark, sf_dir), "user_id", 3600, 86_400), "stalls")
    return found.where("kind <> 'silent'")


def stream_runaway(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), F.repeat(F.col("event_type"), F.lit(20)).alias("piece"))
    return events.run_once(events.runaways(rows, "user_id"), "runaways")


QUERIES = {"stream_event_tail": stream_event_tail, "stream_stall": stream_stall, "stream_runaway": stream_runaway}
ORACLES = {"stream_event_tail": TAIL_SQL, "stream_stall": STALL_SQL}
