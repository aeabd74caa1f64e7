"""Event logs as streams: tails, stalls and runaway output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folium.functions.quality import MOST_CHARS, RATIO, STEP, WINDOW, tail_ratio
from folium.operators.jobs import TERMINAL
from folium.sources.shared import fresh_path


def read_stream(spark: SparkSession, schema, path: str, files_at_once: int = 100, **options) -> DataFrame:
    """A stream of the Parquet files that arrive under ``path``; event times without a zone become timestamps."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).options(**options).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now through the stream and into a table in the shared folder, which is returned."""
    spark = stream.sparkSession
    path, log = fresh_path(spark, name), fresh_path(spark, f"{name}-log")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def terminal(stream: DataFrame, kind: str = "type") -> DataFrame:
    """The tail with ``ended``, true on the event after which a reader stops."""
    return stream.withColumn("ended", F.col(kind).isin(*TERMINAL))


def stalls(stream: DataFrame, key: str, stall: int = 120, total: int = 600, late: str = "10 minutes") -> DataFrame:
    """(key, kind, at) of each key's first silence over ``stall`` seconds, or its passing ``total``.

    State holds three numbers for each key. Rows of a batch are taken in order of time; a key that
    is silent at the end is found by the event-time timer once the watermark passes.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, done = state.get if state.exists else (None, None, False)
        out = []
        if state.hasTimedOut:
            if not done:
                out.append((k[0], "silent", last + stall))
            state.remove()
        else:
            for second in sorted(s for b in batches for s in b["second"]):
                first = second if first is None else first
                if not done and last is not None and second - last > stall:
                    out.append((k[0], "stall", second))
                    done = True
                elif not done and second - first > total:
                    out.append((k[0], "total", second))
                    done = True
                last = max(second, last or second)
            state.update((first, last, done))
            state.setTimeoutTimestamp(max((last + stall) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "kind", "at"])

    rows = stream.withWatermark("ts", late).select(key, "ts", F.unix_timestamp("ts").alias("second"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, kind string, at long", "first long, last long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def runaways(stream: DataFrame, key: str, text: str = "piece", at: str = "seq") -> DataFrame:
    """(key, n_chars, reason) of streams whose output repeats itself or passes the length cap.

    State holds the last window of characters and two counts.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, n, since, done = state.get if state.exists else ("", 0, 0, False)
        out = []
        for piece in pd.concat(list(batches)).sort_values(at)[text]:
            if done:
                break
            tail, n, since = (tail + piece)[-2 * WINDOW :], n + len(piece), since + len(piece)
            reason = None
            if n > MOST_CHARS:
                reason = "length"
            elif since >= STEP and len(tail) >= WINDOW:
                since = 0
                reason = "repetition" if tail_ratio(tail) < RATIO else None
            if reason:
                out.append((k[0], n, reason))
                done = True
        state.update((tail, n, since, done))
        yield pd.DataFrame(out, columns=[key, "n_chars", "reason"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n_chars long, reason string", "tail string, n long, since long, done boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time, final once the watermark passes."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
