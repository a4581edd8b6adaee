"""Inputs of the applications and of trace analytics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_VIEWS = "language STRING, title STRING, requests LONG, size LONG"
IO_LOG = "object_refs ARRAY<STRING>, size LONG, duration DOUBLE, time DOUBLE, _bad STRING"
TRACE = "cat STRING, name STRING, pid STRING, tid STRING, ts DOUBLE, dur DOUBLE, ph STRING"
#: Events of a trace file; a file is read as one array.
TRACE_EVENTS = 50_000


def page_views(spark: SparkSession, *paths: str) -> DataFrame:
    """Space-separated, no header, no quoting; compressed files are read as they are."""
    return spark.read.schema(PAGE_VIEWS).option("sep", " ").option("quote", "").csv(list(paths))


def texts(spark: SparkSession, *paths: str, column: str = "text") -> DataFrame:
    """One column of Parquet files."""
    return spark.read.parquet(*paths).select(column)


def hourly_files(pattern: str, year: int = 2016, months: tuple[int, ...] = (1, 3, 5), days: int = 31, hours: int = 24) -> list[str]:
    """Every month, day and hour through a pattern with ``{year}``, ``{month}``, ``{day}`` and ``{hour}``."""
    return [pattern.format(year=year, month=m, day=d, hour=h) for m in months for d in range(1, days + 1) for h in range(hours)]


def io_log(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines; others are dropped; ``worker`` is ``ip:pid`` from the file's name."""
    raw = spark.read.schema(IO_LOG).option("columnNameOfCorruptRecord", "_bad").json(list(paths))
    name = F.col("_metadata.file_name")
    worker = F.concat_ws(":", F.regexp_extract(name, r"(\d+[.\-]\d+[.\-]\d+[.\-]\d+)", 1), F.regexp_extract(name, r"(\d+)\.\w+$", 1))
    return raw.withColumn("worker", worker).where(F.col("_bad").isNull() & F.col("object_refs").isNotNull()).drop("_bad")


def trace_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of one array of trace events each; what follows a file's first array is no JSON and isn't read."""
    return spark.read.schema(TRACE).option("multiLine", True).json(list(paths))


def write_trace_events(events: DataFrame, path: str, each: int = TRACE_EVENTS) -> None:
    """K9: files of one JSON array with about ``each`` events.  A partition's file gets its brackets as it is
    written, so every file is one array however the rows are dealt, and no array is held in memory."""
    n = max(1, math.ceil(events.count() / each))

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, before = ["["], False
        for batch in batches:
            for line in batch.column(0).to_pylist():
                lines.append(f",{line}" if before else line)
                before = True
            yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
            lines = []
        yield pa.record_batch([pa.array([*lines, "]"], pa.string())], names=["value"])

    rows = events.select(F.to_json(F.struct(*events.columns)).alias("value"))
    rows.repartition(n).mapInArrow(array, "value string").write.option("maxRecordsPerFile", 0).text(path)


def training_curve(spark: SparkSession, *paths: str) -> DataFrame:
    """S17."""
    return spark.read.schema("run STRING, epoch INT, time DOUBLE, accuracy DOUBLE").option("header", True).csv(list(paths))


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """K9: JSON lines or CSV with a header."""
    df.write.json(path) if kind == "json" else df.write.option("header", True).csv(path)
