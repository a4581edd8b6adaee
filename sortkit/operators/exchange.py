"""Exchange and sort: explicit ranges, global order and ranks, random splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sortkit.operators import bounds as B
from sortkit.plans.lineage import cut

_POSITION = (1 << 33) - 1


def range_partition(df: DataFrame, header: str, n: int, edges: Sequence[int] | Callable[[DataFrame, int], Sequence[int]] | None = None, *, sort: bool = True, tie: Sequence[str] = (), part_col: str = "part_id") -> DataFrame:
    """Rows of range i in partition i, ordered inside by header (and ``tie``); one shuffle.

    All n ranges exist, also empty ones.  ``part_col`` carries the range, for plans that merge partitions.  F6: edges
    can be a function of the rows and n."""
    if callable(edges):
        edges = edges(df, n)
    part = B.uniform_id(header, n) if edges is None else B.edge_id(header, edges)
    out = df.withColumn(part_col, part.cast("int")).repartitionById(n, F.col(part_col))
    return out.sortWithinPartitions(part_col, header, *tie) if sort else out


def global_sort(df: DataFrame, *cols: str | Column) -> DataFrame:
    """O1 with sampled ranges, Spark's own."""
    return df.orderBy(*cols)


def global_rank(df: DataFrame, order: Sequence[str], n: int, rank_col: str = "rank") -> DataFrame:
    """Rank from 1 in the order of all rows, without gathering them: rows are dealt to ranges and
    sorted there; a row's rank is its place in its range plus the rows of earlier ranges."""
    # Written once: a second evaluation could sample other ranges, and ranks would not add up.
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_id", 33).cast("int"))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row for each of n ranges
    joined = placed.join(F.broadcast(offsets), "_p")
    return joined.withColumn(rank_col, F.col("_id").bitwiseAND(F.lit(_POSITION)) + F.col("_before") + 1).drop("_id", "_p", "_before")


def with_previous(ranked: DataFrame, value: str, out: str = "previous", rank_col: str = "rank") -> DataFrame:
    """The value of the row one rank before, by an equi-join of ranks."""
    before = ranked.select((F.col(rank_col) + 1).alias(rank_col), F.col(value).alias(out))
    return ranked.join(before, rank_col, "left")


def order_statistics(df: DataFrame, order: Sequence[str], ranks: Sequence[int], n: int) -> DataFrame:
    """The rows at given ranks."""
    return global_rank(df, order, n).where(F.col("rank").isin([int(r) for r in ranks]))


def quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """``(<by>, q, value)``: quantiles by linear interpolation between the two order statistics beside them, of each
    group.  Rows are ranked in ranges over group and value, so neither a group nor its distinct values gather in a task."""
    n = n or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))
    ranked = global_rank(rows, [*by, "_v"], n, "_rank")
    groups = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_m"))
    at = (F.col("_m") - 1) * F.col("q")
    wanted = groups.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))).withColumn("_low", F.floor(at).cast("long")).withColumn("_part", at - F.col("_low"))
    sides = F.array(F.struct(F.lit(0).cast("long").alias("up"), (1 - F.col("_part")).alias("w")), F.struct(F.lit(1).cast("long").alias("up"), F.col("_part").alias("w")))
    wanted = wanted.withColumn("_s", F.explode(sides)).where("_s.w > 0").select(*by, "q", (F.col("_first") + F.col("_low") + F.col("_s.up")).alias("_rank"), F.col("_s.w").alias("_w"))
    return wanted.join(ranked.select("_rank", "_v"), "_rank").groupBy(*by, "q").agg(F.sum(F.col("_v") * F.col("_w")).alias("value"))


def split_at(df: DataFrame, header: str, pivot: bytes | Column) -> tuple[DataFrame, DataFrame]:
    """Rows below the pivot and the others."""
    p = F.lit(bytearray(pivot)) if isinstance(pivot, (bytes, bytearray)) else pivot
    return df.where(F.col(header) < p), df.where(F.col(header) >= p)


def unordered_split(df: DataFrame, n: int) -> DataFrame:
    """Equal slices without any order."""
    return df.repartition(n)


def by_key(df: DataFrame, n: int, key: str | Column) -> DataFrame:
    """Rows of a key together; empty partitions are allowed."""
    return df.repartition(n, key)
