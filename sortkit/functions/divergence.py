"""How far a partial answer is from the final one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9


def snapshot_divergence(snapshots: DataFrame, snapshot: str, key: str, share: str, final: int) -> DataFrame:
    """``(snapshot, divergence)``, the sum of x ln(x / (y + e) + e) over all keys, where x is the
    snapshot's share and y that of the snapshot numbered ``final``.  A key absent from x adds nothing,
    so an inner side of x with y filled in equals the full alignment."""
    truth = snapshots.where(F.col(snapshot) == final).select(key, F.col(share).alias("_y"))
    joined = snapshots.join(truth, key, "left")
    y = F.coalesce(F.col("_y"), F.lit(0.0))
    term = F.col(share) * F.log(F.col(share) / (y + EPSILON) + EPSILON)
    return joined.groupBy(snapshot).agg(F.sum(term).alias("divergence"))


def truth_prefix(ranked: DataFrame, truth: DataFrame, rank: str, key: str) -> DataFrame:
    """One row ``n_correct``: ranks from 1 on which both tables agree before the first that differs."""
    joined = ranked.select(rank, F.col(key).alias("_a")).join(truth.select(rank, F.col(key).alias("_b")), rank)
    agg = joined.agg(F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col(rank))).alias("_w"), F.count(F.lit(1)).alias("_n"))
    return agg.select(F.coalesce(F.col("_w") - 1, F.col("_n")).cast("long").alias("n_correct"))
