"""Random shuffles for training data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def draw(seed: int, *identity: str) -> Column:
    """A row's place in the permutation: a hash of seed and identity, the same whenever computed."""
    return F.xxhash64(F.lit(seed), *identity)


def full_shuffle(df: DataFrame, n: int, seed: int, *identity: str) -> DataFrame:
    """A random permutation: dealt at random to n partitions and put in random order there.  With
    ``identity`` columns it is reproducible; rows equal in them go together."""
    order = draw(seed, *identity) if identity else F.rand(seed)
    return df.withColumn("_r", order).repartitionByRange(n, "_r").sortWithinPartitions("_r").drop("_r")


def windowed_shuffle(df: DataFrame, block: str | Column, window: int, n: int, seed: int, *identity: str) -> DataFrame:
    """Blocks keep their order in windows of ``window`` blocks; inside a window rows are shuffled.
    Carries the window in ``batch``."""
    b = F.col(block) if isinstance(block, str) else block
    out = df.withColumn("batch", F.floor(b / window).cast("long")).withColumn("_r", draw(seed, *identity))
    return out.repartitionByRange(n, "batch", "_r").sortWithinPartitions("batch", "_r").drop("_r")


def deliver(df: DataFrame, prefetch: bool = True) -> Iterator[Row]:
    """Rows one partition at a time, the next fetched meanwhile; the driver holds two partitions."""
    return df.toLocalIterator(prefetchPartitions=prefetch)
