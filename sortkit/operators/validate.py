"""Is it sorted, and is it all there?"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sortkit.functions.keys import fingerprint


def partition_summaries(sorted_df: DataFrame, header: str, part_col: str) -> DataFrame:
    """V1: ``(part_id, n_rows, first_key, last_key, n_inversions)`` in the physical order of the rows.

    One pass over Arrow batches, no shuffle; a physical partition gives a row for each part in it.
    Sorting the rows again would hide what is to be checked, so nothing here sorts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            part, key = batch.column(0), batch.column(1)
            for p in pc.unique(part).to_pylist():
                own = key if len(pc.unique(part)) == 1 else key.filter(pc.equal(part, p))
                if not len(own):
                    continue
                wrong = pc.sum(pc.less(own[1:], own[:-1])).as_py() or 0
                first, last = own[0].as_py(), own[-1].as_py()
                if p in rows:
                    r = rows[p]
                    rows[p] = [r[0] + len(own), r[1], last, r[3] + wrong + (first < r[2])]
                else:
                    rows[p] = [len(own), first, last, wrong]
        values = list(zip(*([k, *v] for k, v in rows.items()))) or [[]] * 5
        yield pa.record_batch([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["part_id", "n_rows", "first_key", "last_key", "n_inversions"])

    return sorted_df.select(F.col(part_col).cast("int").alias("part_id"), F.col(header).alias("key")).mapInArrow(scan, "part_id int, n_rows long, first_key binary, last_key binary, n_inversions long")


def cross_check(summaries: DataFrame) -> DataFrame:
    """V2: summaries with ``follows``: no key of a part is below the last key of the part before.  The
    table has one row for each part, so one task may order it."""
    before = F.lag("last_key").over(Window.orderBy("part_id"))
    return summaries.withColumn("follows", F.coalesce(F.col("first_key") >= before, F.lit(True)))


def conservation(df: DataFrame, size: F.Column, *identity: str) -> DataFrame:
    """``(n_rows, n_bytes, checksum)``; the checksum is a sum of row fingerprints, whatever the order."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.sum(fingerprint(*identity).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum"),
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two conservation rows side by side, and whether they agree."""
    a = before.select(*(F.col(c).alias(f"{c}_in") for c in before.columns))
    b = after.select(*(F.col(c).alias(f"{c}_out") for c in after.columns))
    same = F.lit(True)
    for c in before.columns:
        same = same & F.col(f"{c}_in").eqNullSafe(F.col(f"{c}_out"))
    return a.crossJoin(b).withColumn("ok", same)


def check_file_sizes(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """V4: ``(path, size, n_bytes, ok)`` of files read by ``df`` (a ``binaryFile`` frame) against a manifest."""
    have = df.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("n_bytes"))
    return manifest.select("path", "size").join(have, "path", "left").withColumn("ok", F.col("size").eqNullSafe(F.col("n_bytes")))


def validate_sort(source: DataFrame, result: DataFrame, header: str, part_col: str, size: F.Column, *identity: str) -> DataFrame:
    """Everything at once: ``(n_parts, n_inversions, n_gaps, ok)``."""
    s = cross_check(partition_summaries(result, header, part_col))
    order = s.agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_inversions").alias("n_inversions"), F.sum((~F.col("follows")).cast("long")).alias("n_gaps"))
    kept = compare(conservation(source, size, *identity), conservation(result, size, *identity)).select(F.col("ok").alias("kept"))
    return order.crossJoin(kept).select("n_parts", "n_inversions", "n_gaps", ((F.col("n_inversions") == 0) & (F.col("n_gaps") == 0) & F.col("kept")).alias("ok"))
