"""Sort keys and partition keys.

A sort key is a BINARY header, compared byte by byte as unsigned.  Its partition key is the first 8
bytes as a big-endian unsigned number; Spark has no unsigned long, so it is a DECIMAL(20, 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 10
BODY_BYTES = 90
RECORD_BYTES = HEADER_BYTES + BODY_BYTES
KEY_BYTES = 8
MAX_KEY = 2**64 - 1
PART_SHIFT = 16


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_header(value: str | Column, size: int = HEADER_BYTES) -> Column:
    """A header derived from any value: the first bytes of the MD5 of its text (null gives null)."""
    return F.substring(F.unhex(F.md5(_col(value).cast("string").cast("binary"))), 1, size)


def key_number(header: str | Column, size: int = KEY_BYTES) -> Column:
    """The partition key as a number."""
    return F.conv(F.hex(F.substring(_col(header), 1, size)), 16, 10).cast("decimal(20,0)")


def key_number_little_endian(header: str | Column, size: int = KEY_BYTES) -> Column:
    """The first bytes as a little-endian number; the hex pairs are reversed."""
    pairs = F.regexp_extract_all(F.hex(F.substring(_col(header), 1, size)), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")


def words(text: str | Column) -> Column:
    """Lower-cased words between Unicode white space, as an array; null text gives null."""
    return F.filter(split_words(text), lambda w: w != "")


def split_words(text: str | Column) -> Column:
    """``words`` with an empty one where white space stands at an end; cheaper to drop once they are rows."""
    return F.split(F.lower(_col(text)), r"(?U)\s+")


def prefix(name: str | Column, mark: str = ".") -> Column:
    """What stands before the first mark."""
    return F.substring_index(_col(name), mark, 1)


def first_char_bucket(s: str | Column, n: int) -> Column:
    """P5: code point of the first character modulo n; 0 for the empty string."""
    return F.pmod(F.ascii(_col(s)), F.lit(n))


def proportion(value: str | Column, total: str | Column) -> Column:
    """A share, 0 if there is no total."""
    return F.when(_col(total) != 0, _col(value) / _col(total)).otherwise(F.lit(0.0))


def mib_per_second(size: str | Column, seconds: str | Column) -> Column:
    """P7."""
    return _col(size) / _col(seconds) / F.lit(1024.0 * 1024.0)


def epoch_time(seconds: str | Column) -> Column:
    """Seconds since 1970 as a timestamp."""
    return F.timestamp_seconds(_col(seconds))


def remap(refs: str | Column, mapping: str | Column) -> Column:
    """Every array element through a map column, itself where the map has none."""
    return F.transform(_col(refs), lambda r: F.coalesce(F.element_at(_col(mapping), r), r))


def spilled_mib(line: str | Column) -> Column:
    """P10: the number in a spill log line, null if there is none."""
    found = F.regexp_extract(_col(line), r"Spilled (\d+) MiB", 1)
    return F.when(found != "", found.cast("long"))


def clock_seconds(text: str | Column) -> Column:
    """``minutes:seconds`` as seconds."""
    parts = F.split(_col(text), ":")
    return parts[0].cast("long") * 60 + parts[1].cast("long")


def mib_to_gb(mib: str | Column) -> Column:
    return _col(mib) * F.lit(1024.0 * 1024.0 / 1e9)


def to_micros(seconds: str | Column) -> Column:
    return (_col(seconds) * F.lit(1_000_000)).cast("long")


def part_hex(part_id: str | Column) -> Column:
    """A part id as 10 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(_col(part_id)), 10, "0"))


def part_from_hex(text: str | Column) -> Column:
    return F.conv(_col(text), 16, 10).cast("long")


def part_id(*parts: str | Column) -> Column:
    """Parts packed 16 bits apart, the first highest."""
    out = F.lit(0).cast("long")
    for p in parts:
        out = F.shiftleft(out, PART_SHIFT) + _col(p).cast("long")
    return out


def shard(part: str | Column, buckets: int) -> tuple[Column, Column]:
    """(bucket number, four hex digits of path prefix) by a hash that is the same everywhere."""
    s = F.pmod(F.xxhash64(_col(part)), F.lit(1 << PART_SHIFT))
    return F.pmod(s, F.lit(buckets)), F.lower(F.lpad(F.hex(s), 4, "0"))


def checksum_hex(total: str | Column) -> Column:
    """A checksum, a sum of fingerprints as DECIMAL(38, 0), in lower-case hex without leading zeros."""
    t = _col(total).cast("decimal(38,0)")
    limb = F.lit(1 << 60).cast("decimal(38,0)")
    low = (t % limb).cast("long")
    high = ((t - t % limb) / F.lit(float(1 << 60))).cast("long")  # a multiple of 2**60 below 2**113: exact in a double
    return F.lower(F.when(high == 0, F.hex(low)).otherwise(F.concat(F.hex(high), F.lpad(F.hex(low), 15, "0"))))


def decode_hex(record: str | Column, header_only: bool = False) -> Column:
    """A record, or its header, as lower-case hex."""
    r = _col(record)
    return F.lower(F.hex(F.substring(r, 1, HEADER_BYTES) if header_only else r))


def fingerprint(*values: str | Column) -> Column:
    """A row's fingerprint: 60 bits of the MD5 of its values' text, as a long."""
    text = F.concat_ws("|", *(F.coalesce(_col(v).cast("string"), F.lit("~")) for v in values))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
