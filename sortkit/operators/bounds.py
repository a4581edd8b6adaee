"""Boundaries of ranges over partition keys.

Range i is ``[edge i, edge i + 1)``, the first edge is 0 and the last range is open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortkit.functions.keys import MAX_KEY, key_number


#: Keys sampled for each range, on average.
PER_RANGE = 200


def uniform_edges(n: int) -> list[int]:
    """N equal steps of the key space; what is left over goes to the last range."""
    if n < 1:
        raise ValueError("at least one range")
    step = MAX_KEY // n
    return [i * step for i in range(n)]


def two_level_edges(coarse: int, fine_total: int) -> list[list[int]]:
    """``coarse`` ranges, each of ``ceil(fine_total / coarse)`` fine ones."""
    each = -(-fine_total // coarse)
    flat = uniform_edges(coarse * each)
    return [flat[i * each : (i + 1) * each] for i in range(coarse)]


def uniform_id(header: str | Column, n: int) -> Column:
    """X1 as an expression: the number of the uniform range, from 0."""
    step = F.lit(str(MAX_KEY // n)).cast("decimal(20,0)")
    key = key_number(header)
    quotient = (key - key % step) / step  # exact: decimals divide to a fraction otherwise
    return F.least(quotient.cast("int"), F.lit(n - 1)) if n > 1 else F.when(key.isNotNull(), F.lit(0))


def edge_id(header: str | Column, edges: Sequence[int]) -> Column:
    """The number of the range among given edges, by a balanced tree of byte comparisons."""
    key = F.substring(F.col(header) if isinstance(header, str) else header, 1, 8)

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bytearray(int(edges[mid]).to_bytes(8, "big"))), tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(edges))


def interpolated_edges(values: Sequence[int] | DataFrame, n: int, size: int = 1, col: str = "value") -> list[int]:
    """N + 1 quantile edges by linear interpolation, rounded down, of the values with 0 and the largest
    number of ``size`` bytes added."""
    top = 256**size - 1
    qs = [i / n for i in range(n + 1)]
    if isinstance(values, DataFrame):
        from sortkit.operators.exchange import quantiles

        ends = values.sparkSession.createDataFrame([(0.0,), (float(top),)], "v double")
        all_ = values.select(F.col(col).cast("double").alias("v")).unionByName(ends)
        return [int(r["value"]) for r in quantiles(all_, "v", qs).orderBy("q").collect()]
    v = sorted([0, top, *values])
    out = []
    for q in qs:
        at = q * (len(v) - 1)
        i = min(int(at), len(v) - 2)
        out.append(int(v[i] + (v[i + 1] - v[i]) * (at - i)))
    return out


def sampled_edges(df: DataFrame, header: str, n: int, fraction: float | None = None, seed: int = 42, per_range: int = PER_RANGE) -> list[int]:
    """X3, S6 on a sample: the nearest order statistics of the sampled keys with both ends added.

    Only the header column is read.  Rows are drawn from all partitions alike; without a ``fraction`` about
    ``per_range`` for each range, so the sample grows with the ranges and not with the rows."""
    keys = df.select(key_number(header).alias("k")).where("k is not null")
    if fraction is None:
        fraction = min(1.0, n * per_range / max(1, keys.count()))
    return nearest_edges([0, *(int(r[0]) for r in keys.sample(fraction, seed).toLocalIterator()), MAX_KEY], n)


def nearest_edges(values: Sequence[int], n: int) -> list[int]:
    """The order statistic nearest to each quantile i / n, i < n; halves go to the even index."""
    v = sorted(values)
    return [v[round((len(v) - 1) * (i / n))] for i in range(n)]


def edges_for(df: DataFrame, header: str, n: int, kind: str = "uniform", fraction: float | None = None) -> list[int]:
    """Uniform or sampled edges."""
    if kind == "uniform":
        return uniform_edges(n)
    if kind == "sampled":
        return sampled_edges(df, header, n, fraction)
    raise ValueError(f"unknown kind of bounds: {kind}")
