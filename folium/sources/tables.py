"""Reading and writing: page images, job records, event logs, documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folium.operators.jobs import SUFFIXES

PAGE = "struct<index:int,image:string,latex:string,status:string,attempts:int,engine:string,compile_ok:boolean>"
RESULT = "struct<ok:boolean,pages_ok:int,pages:int,pdf:string,tex:string,aborted:string,saved_to:string>"
JOB_DDL = f"id string, status string, created_at double, updated_at double, filenames array<string>, pages array<{PAGE}>, result {RESULT}, error string"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(page_index, path, image) of the pictures under ``path``, numbered in order of their names; others are an error when read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    checked = found.withColumn("path", F.when(suffix.isin(*SUFFIXES), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsupported picture: "), F.col("path")))))
    numbered = checked.withColumn("page_index", F.row_number().over(Window.orderBy("path")))
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    same = lambda c: F.regexp_replace(c, r"^(\w+:)/+", "$1/")  # noqa: E731  the two sources spell a path's start differently
    images = images.select(same(F.col("image.origin")).alias("_origin"), "image")
    return numbered.join(images, same(F.col("path")) == F.col("_origin")).select("page_index", "path", "image")


class PageRenderer:
    """S2's plug: ``render(data, dpi)`` gives the PNG of each page of a PDF."""

    def render(self, data: bytes, dpi: int) -> Iterator[bytes]:
        raise NotImplementedError("no PDF renderer is installed; pass one with a render method")


def read_pdf(spark: SparkSession, path: str, renderer: PageRenderer, dpi: int = 200, start: int = 1) -> DataFrame:
    """(path, page_index, png): the pages of each PDF, numbered on from ``start``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for i, png in enumerate(renderer.render(row["content"], dpi)):
                    yield pa.RecordBatch.from_pylist([{"path": row["path"], "page": i, "png": png}], schema=pa.schema([("path", pa.string()), ("page", pa.int32()), ("png", pa.binary())]))

    pages = files.mapInArrow(run, "path string, page int, png binary")
    return pages.withColumn("page_index", F.row_number().over(Window.orderBy("path", "page")) + start - 1).drop("page")


def write_pages(pages: DataFrame, path: str) -> None:
    """S3: (page_index, png) as rows of a binary column under the names that pages have."""
    pages.select(F.format_string("%04d.png", F.col("page_index")).alias("name"), "png").write.mode("overwrite").parquet(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A record for each ``job.json``; one that can't be read has only nulls and is left out."""
    return spark.read.schema(JOB_DDL).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "job.json").json(path).where("id is not null")


def write_jobs(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)


def new_jobs(names: DataFrame, now: Column, token: Column | None = None) -> DataFrame:
    """(filenames) to pending jobs with ids of time and six digits; pass ``token`` for ids that can be repeated."""
    tail = token if token is not None else F.substring(F.expr("uuid()"), 1, 6)
    second = F.unix_timestamp(now).cast("double")
    return names.select(
        F.concat(F.date_format(now, "yyyyMMdd-HHmmss"), F.lit("-"), tail).alias("id"), F.lit("pending").alias("status"),
        second.alias("created_at"), second.alias("updated_at"), "filenames", F.lit(None).cast("string").alias("error"),
    )


def append_events(events: DataFrame, path: str) -> None:
    """A JSON line for each event, added to the log."""
    events.select(F.to_json(F.struct("*")).alias("value"), "job_id").write.mode("append").partitionBy("job_id").text(path)


def read_events(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """(job_id, seq, type, ts, payload) from the ``after``-th line on; seq counts all lines, bad ones are left out."""
    lines = spark.read.text(path).select("job_id", "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("file", "line")) - 1
    parsed = lines.withColumn("seq", seq).withColumn("event", F.from_json("value", "type string, ts double")).withColumn("payload", F.try_parse_json("value"))
    return parsed.where(F.col("seq") >= after).where("payload is not null and event.type is not null").select("job_id", "seq", "event.type", "event.ts", "payload")


def write_documents(documents: DataFrame, path: str, key: str = "job_id") -> None:
    """Each job's document as text in a folder of its own."""
    documents.select(F.col("tex").alias("value"), key).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def compile_documents(documents: DataFrame, compiler, key: str = "job_id") -> DataFrame:
    """(key, ok, errors) with ``compiler.compile(tex) -> list of errors``, a task for each batch of jobs.

    Compilers are outside programs: the result should be written before it is used twice.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            found = [compiler.compile(t) for t in batch["tex"]]
            yield pd.DataFrame({key: batch[key], "ok": [not e for e in found], "errors": [e[:5] for e in found]})

    return documents.select(key, "tex").mapInPandas(run, f"{key} {kind}, ok boolean, errors array<string>")


def export(documents: DataFrame, path: str, name: str = "name") -> DataFrame:
    """Writes documents under unique names; returns (name, error), the error null where all went well."""
    try:
        documents.select(F.col("tex").alias("value"), name).write.mode("append").partitionBy(name).text(path)
        return documents.select(name, F.lit(None).cast("string").alias("error"))
    except Exception as e:  # a save that fails is reported, as an event would
        return documents.select(name, F.lit(str(e)[:500]).alias("error"))


class TranscriptSource(DataSource):
    """A Python data source ``transcript``: rows (job_id, page_index, latex) of text files named ``<job>_<page>.tex``."""

    @classmethod
    def name(cls) -> str:
        return "transcript"

    def schema(self) -> str:
        return "job_id string, page_index int, latex string"

    def reader(self, schema) -> DataSourceReader:
        return TranscriptReader(self.options["path"])


class TranscriptReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(f"{self.path}/*.tex"))] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        import os

        if partition.value is not None:
            job, _, page = os.path.basename(partition.value)[:-4].rpartition("_")
            with open(partition.value, encoding="utf-8") as f:
                yield job, int(page), f.read()
