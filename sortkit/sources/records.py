"""100-byte records: a 10-byte header and a 90-byte body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortkit.functions.keys import BODY_BYTES, HEADER_BYTES, RECORD_BYTES, checksum_hex, fingerprint

GB = 1_000_000_000


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """``(header, body)`` of binary files, split between records.  Files whose length isn't a
    multiple of 100 bytes fail.  Spark's reader of fixed-width records gives an RDD, which becomes a DataFrame
    in the JVM, so no row passes through Python."""
    sc = spark.sparkContext
    raw = sc._jsc.binaryRecords(",".join(paths), RECORD_BYTES).rdd()
    df = DataFrame(spark._jsparkSession.createDataset(raw, sc._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).toDF("r")
    return df.select(F.substring("r", 1, HEADER_BYTES).alias("header"), F.substring("r", HEADER_BYTES + 1, BODY_BYTES).alias("body"))


def generated(spark: SparkSession, offset: int, n: int, parts: int, skewed: bool = False) -> DataFrame:
    """Records ``offset .. offset + n - 1`` of one endless sequence: ``(id, header, body)``.

    A record follows from its number alone.  Skewed headers share one of few prefixes: half of all
    records have the same first 6 bytes, a quarter another, and so on."""
    ids = spark.range(offset, offset + n, 1, parts)
    digest = F.unhex(F.md5(F.col("id").cast("string").cast("binary")))
    header = F.substring(digest, 1, HEADER_BYTES)
    if skewed:
        group = F.floor(F.log2(F.greatest(F.lit(1.0), F.lit(64.0) / (F.pmod(F.col("id"), F.lit(64)) + 1)))).cast("string")
        header = F.concat(F.substring(F.unhex(F.md5(group.cast("binary"))), 1, 6), F.substring(digest, 1, HEADER_BYTES - 6))
    body = F.substring(F.encode(F.rpad(F.concat(F.lpad(F.col("id").cast("string"), 20, "0"), F.hex(digest)), BODY_BYTES, "."), "UTF-8"), 1, BODY_BYTES)
    return ids.select("id", header.alias("header"), body.alias("body"))


def random_records(spark: SparkSession, n: int, parts: int, seed: int = 42) -> DataFrame:
    """Seeded random headers with empty bodies."""
    word = lambda s: F.lpad(F.hex((F.rand(s) * 2**40).cast("long")), 10, "0")
    return spark.range(0, n, 1, parts).select(F.unhex(F.concat(word(seed), word(seed + 1))).alias("header"), F.unhex(F.lit("00" * BODY_BYTES)).alias("body"))


def generate_parts(spark: SparkSession, total: int, part_records: int, workers: int, shards: int = 1) -> DataFrame:
    """The plan of an input: ``(m, w, shard, offset, n)`` of parts of ``part_records``, dealt round over
    mappers, workers and shards; the last part is shorter."""
    n_parts = -(-total // part_records)
    ids = spark.range(n_parts)
    return ids.select(
        F.floor(F.col("id") / (workers * shards)).alias("m"), F.pmod(F.floor(F.col("id") / shards), F.lit(workers)).alias("w"), F.pmod("id", F.lit(shards)).alias("shard"),
        (F.col("id") * part_records).alias("offset"), F.least(F.lit(part_records), F.lit(total) - F.col("id") * part_records).alias("n"),
    )


def write_ranges(sorted_df: DataFrame, path: str, part_col: str = "part_id") -> DataFrame:
    """K1, K5: write range partitions as Parquet, a folder for each, and give the manifest of what was
    written: ``(part_id, path, n_rows, size, checksum)`` of record bytes, the checksum in hex."""
    sorted_df.write.partitionBy(part_col).parquet(path)
    back = sorted_df.sparkSession.read.parquet(path)
    return back.groupBy(F.col(part_col).cast("long").alias("part_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("header") + F.octet_length("body")).cast("long").alias("size"),
        checksum_hex(F.sum(fingerprint(F.hex("header"), F.hex("body")).cast("decimal(38,0)"))).alias("checksum"),
    ).select("part_id", F.concat(F.lit(f"{path}/{part_col}="), "part_id").alias("path"), "n_rows", "size", "checksum")


def write_records(df: DataFrame, path: str, last: bytes = b".") -> None:
    """K1: header and body as 100-byte binary records, a file for each partition, in its order.

    Spark's text sink writes a string's bytes as they are and ends each row with a mark, which here is the
    records' last byte; a record that ends otherwise raises."""
    r = F.concat("header", "body")
    fits = (F.octet_length(r) == RECORD_BYTES) & (F.substring(r, RECORD_BYTES, 1) == F.lit(bytearray(last)))
    line = F.when(fits, F.substring(r, 1, RECORD_BYTES - 1).cast("string")).otherwise(F.raise_error(F.lit(f"a record doesn't end with {last!r}")).cast("string"))
    df.select(line.alias("value")).write.option("lineSep", last.decode("latin-1")).text(path)


def drain(df: DataFrame) -> None:
    """K7: run a plan to its end and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
