"""Manifests: header-less CSV of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortkit.functions.keys import part_from_hex, part_hex

COLUMNS = ("part_id", "node", "bucket", "path", "size", "checksum")
_SCHEMA = "part_id string, node string, bucket string, path string, size long, checksum string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Absent strings are read as empty, not null."""
    raw = spark.read.schema(_SCHEMA).option("emptyValue", "").csv(path)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("node", "bucket", "path")]
    return raw.select(part_from_hex("part_id").alias("part_id"), *text, "size", F.coalesce("checksum", F.lit("")).alias("checksum"))


def write_manifest(parts: DataFrame, path: str) -> None:
    """K5: missing columns and nulls are written as empty."""
    have = set(parts.columns)
    text = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in COLUMNS[1:]]
    parts.select(part_hex("part_id").alias("part_id"), *text).write.option("emptyValue", "").csv(path)


def synthetic_manifest(spark: SparkSession, n: int, size: int) -> DataFrame:
    """Entries for a run without input."""
    return spark.range(n).select(F.col("id").alias("part_id"), *(F.lit("").alias(c) for c in ("node", "bucket", "path")), F.lit(size).cast("long").alias("size"), F.lit("").alias("checksum"))
