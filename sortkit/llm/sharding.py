"""Sharding by extendible hashing.

Every row's key gives 60 hash bits.  Bucket (d, p) holds the rows whose first d bits are p.  Only a
bucket over the byte limit is split on its next bit, so a row's shard is the bucket of least depth
that fits among those that hold it.  The directory, one row for each cell of ``global depth`` bits,
is a table; it is made from sums of cells and never from rows.

Equal keys can't be told apart by any bit: a bucket that is over the limit at full depth stays one
shard with overflow pages.  Its rows are numbered, written once so that the numbers stay, dealt by them to
parts of some pages, and a part is paged by the bytes before a row: a page takes the rows that begin within
half a limit, so that it holds the limit, and a row above half of it has a page alone.

Defined results: a null key hashes as the empty string; null text has 0 bytes; an empty table gives
no rows; further columns are kept by :func:`write_shards` and ignored by :func:`assign_shards`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortkit.llm.common import cut, stash

BITS = 60
#: Bytes of text in a shard.
SHARD_BYTES = 16 * 1024 * 1024
#: Bits that a round's cells have beyond the depth that even splitting needs.
SPARE_BITS = 4
#: Limits of bytes, and rows, in a part of an overflowing bucket.
PART_LIMITS = 16
PART_ROWS = 500_000


def hashed(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``(key, h, bytes, <more>)`` with the 60 hash bits as a long."""
    digest = F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(key_col).alias("key"),
        F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("h"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"),
        *more,
    )


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """``(cell_bits, cell, depth, prefix, shard_bytes, shard_rows)`` for every cell that holds rows, and
    the widths of cells used.  Buckets that don't fit at one width are counted again at a larger one."""
    total = int(rows.agg(F.sum("bytes")).first()[0] or 0)
    bits = min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE_BITS)
    least, found, widths, open_rows = 0, None, [], rows
    while True:
        cells = open_rows.groupBy(F.expr(f"shiftright(h, {BITS - bits})").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        spread = cut(cells).withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(bits))))
        spread = spread.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        buckets = spread.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        if bits == BITS:
            fits = fits | (F.col("depth") == BITS)
        leaf = spread.select("cell", "depth", "prefix").join(buckets.where(fits), ["depth", "prefix"])
        leaf = leaf.groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_rows"), "depth").alias("leaf")).select(F.lit(bits).alias("cell_bits"), "cell", "leaf.*")
        leaf = cut(leaf)
        found = leaf if found is None else found.unionByName(leaf)
        widths.append(bits)
        if bits == BITS:
            break
        whole = cells.join(leaf, "cell", "left_anti").select("cell")
        if whole.isEmpty():
            break
        open_rows = open_rows.join(whole, F.expr(f"shiftright(h, {BITS - bits})") == F.col("cell"), "left_semi")
        least, bits = bits + 1, min(BITS, bits + 8)
    return found, widths


def _placed(docs: DataFrame, limit: int, key_col: str, text_col: str, carry: bool) -> DataFrame:
    """``hashed`` rows with their bucket and page; with ``carry`` also the whole row as ``row``."""
    rows = hashed(docs, key_col, text_col)
    cells, widths = directory(rows, limit)
    if carry:
        rows = hashed(docs, key_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = None
    for bits in widths:
        at = cells.where(F.col("cell_bits") == bits).drop("cell_bits")
        part = rows.withColumn("cell", F.expr(f"shiftright(h, {BITS - bits})")).join(at, "cell")
        out = part if out is None else out.unionByName(part)
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    first = F.lit(0).cast("int").alias("page")
    if cells.where(over).isEmpty():
        return out.select("*", first)
    return out.where(~over).select("*", first).unionByName(_paged(out.where(over), limit))


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets over the limit with a ``page`` whose bytes are within it, or that holds one row."""
    rows = stash(rows.withColumn("nr", F.monotonically_increasing_id()))
    parts = F.greatest(F.ceil(F.col("shard_bytes") / F.lit(PART_LIMITS * limit)), F.ceil(F.col("shard_rows") / F.lit(PART_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("nr"), parts))
    part = ("depth", "prefix", "part")
    before = Window.partitionBy(*part).orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    alone = F.col("bytes") * 2 > limit
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    shared = F.floor(total(F.when(alone, 0).otherwise(F.col("bytes"))) * 2 / F.lit(limit)) * 2
    rows = rows.withColumn("at", F.when(alone, total(alone.cast("long")) * 2 + 1).otherwise(shared))
    wide = rows.groupBy(*part).agg((F.max("at") + 1).alias("wide"))
    start = F.coalesce(F.sum("wide").over(Window.partitionBy("depth", "prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(wide.select(*part, start.alias("start")))
    return rows.join(starts, list(part)).withColumn("page", (F.col("start") + F.col("at")).cast("int")).drop("part", "nr", "at", "start")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<key_col>, bytes, shard_depth, shard_prefix, page, shard_bytes)`` for every row."""
    return _placed(docs, limit, key_col, text_col, False).select(
        F.col("key").alias(key_col), "bytes", F.col("depth").cast("int").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), "page", "shard_bytes"
    )


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows as Parquet, partitioned by shard.  Every row is written once, whatever its key."""
    shard = F.format_string("%02d-%d-%d", F.col("depth").cast("int"), "prefix", "page").alias("shard")
    _placed(docs, limit, key_col, text_col, True).select("row.*", shard).repartition("shard").write.partitionBy("shard").parquet(path)


ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}))::BIGINT AS h,
         coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes
  FROM documents),
levels AS (SELECT rows.*, d, h >> ({BITS} - d) AS p FROM rows, (SELECT unnest(range(0, 31)) AS d)),
buckets AS (SELECT d, p, sum(bytes)::BIGINT AS size, count(*) AS n FROM levels GROUP BY d, p),
leaf AS (
  SELECT l.doc_id, l.h, l.bytes, min(l.d) AS d
  FROM levels l JOIN buckets b ON l.d = b.d AND l.p = b.p
  WHERE b.size <= {SHARD_BYTES} OR b.n = 1 GROUP BY ALL)
SELECT leaf.doc_id, leaf.bytes, leaf.d::INT AS shard_depth, b.p AS shard_prefix, 0::INT AS page, b.size AS shard_bytes
FROM leaf JOIN buckets b ON b.d = leaf.d AND b.p = leaf.h >> ({BITS} - leaf.d)
"""
