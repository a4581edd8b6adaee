"""Analytics of execution traces: completion, concurrency, rates, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortkit.operators.exchange import global_rank


def events_of(df: DataFrame, name: str, *wanted: str) -> DataFrame:
    """Spans of the given events."""
    return df.where(F.col(name).isin(*wanted))


def relative_time(df: DataFrame, start: str, out: str = "t") -> DataFrame:
    """Time since the first start; the first start is one row."""
    first = df.agg(F.min(start).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn(out, F.col(start) - F.col("_first")).drop("_first")


def completion_curve(df: DataFrame, end: str, tie: list[str], n: int) -> DataFrame:
    """``(end, pct)``: per cent of spans that are done when each ends."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    r = global_rank(df.select(end, *tie), [end, *tie], n)
    return r.crossJoin(F.broadcast(total)).select(end, *tie, (F.col("rank") * 100.0 / F.col("_n")).alias("pct"))


def series_curves(df: DataFrame, series: str, start: str, end: str, n: int) -> DataFrame:
    """``(series, t, pct)`` of every series' ends since the first start of all, with a first point (0.000001, 0)
    and a last (the last end of all, 100) for each.  Ranks inside a series follow from the ranks of all
    rows in the order of series and end."""
    bounds = df.agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    sizes = df.groupBy(series).agg(F.count(F.lit(1)).alias("_n"))
    placed = global_rank(df.select(series, end), [series, end], n)
    firsts = placed.groupBy(series).agg(F.min("rank").alias("_first"))
    about = sizes.join(firsts, series)
    points = placed.join(about, series).crossJoin(F.broadcast(bounds))
    points = points.select(series, (F.col(end) - F.col("_lo")).alias("t"), ((F.col("rank") - F.col("_first") + 1) * 100.0 / F.col("_n")).alias("pct"))
    ends = sizes.crossJoin(F.broadcast(bounds))
    zero = ends.select(series, F.lit(0.000001).alias("t"), F.lit(0.0).alias("pct"))
    full = ends.select(series, (F.col("_hi") - F.col("_lo")).alias("t"), F.lit(100.0).alias("pct"))
    return points.unionByName(zero).unionByName(full)


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of two tables; each side is made distinct before the shuffle."""
    return a.select(key).unionByName(b.select(key)).distinct()


def hopping_counts(df: DataFrame, at: str, size: float, step: float) -> DataFrame:
    """``(k, n)``: events in window k, ``[first - size + k step, first + k step]``, closed at both ends, for
    all windows that begin no later than the last event.  An event names its windows; nothing is joined by range."""
    ends = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    begin = F.col("lo") - size
    t = df.where(F.col(at).isNotNull()).select(F.col(at).alias("t")).crossJoin(F.broadcast(ends))
    last = F.floor((F.col("hi") - begin) / step)
    first_k = F.greatest(F.ceil((F.col("t") - size - begin) / step), F.lit(0))
    last_k = F.least(F.floor((F.col("t") - begin) / step), last)
    counted = t.where(first_k <= last_k).select(F.explode(F.sequence(first_k, last_k)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    every = ends.where("lo is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    return every.join(counted, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


def concurrency(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str, weight: str, width: float) -> DataFrame:
    """For each point, the number and total weight of the intervals with ``start <= t < end``.

    Range join by slots: an interval names the slots of ``width`` that it touches, a point is in one slot;
    equal slots are joined and checked.  Intervals far longer than ``width`` name many slots, so choose it
    near their usual length."""
    slot = lambda c: F.floor(c / width)
    a = points.select(F.col(t).alias("_t")).distinct().withColumn("_s", slot(F.col("_t")))
    b = intervals.where(F.col(start) < F.col(end)).select(F.col(start).alias("_b"), F.col(end).alias("_e"), F.col(weight).alias("_w"))
    b = b.withColumn("_s", F.explode(F.sequence(slot(F.col("_b")), slot(F.col("_e")))))
    hit = a.join(b, "_s").where("_b <= _t and _t < _e").groupBy("_t").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("total"))
    return a.select("_t").join(hit, "_t", "left").select(F.col("_t").alias(t), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def every_nth(df: DataFrame, order: list[str], n: int, parts: int) -> DataFrame:
    """Each n-th row in an order, from the first."""
    return global_rank(df, order, parts).where((F.col("rank") - 1) % n == 0)


def lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, dim_value: str, out: str) -> DataFrame:
    """The dimension's value, or the key itself where it has none."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(dim_value).alias("_v"))
    return df.join(d, F.col(key) == F.col("_k"), "left").withColumn(out, F.coalesce("_v", key)).drop("_k", "_v")


def lookup_elements(df: DataFrame, refs: str, row_id: str, dim: DataFrame, dim_key: str, dim_value: str) -> DataFrame:
    """P9 for dimensions of any size: ``(row_id, refs)`` with each element looked up, in its order."""
    parts = df.select(row_id, F.posexplode_outer(refs).alias("_p", "_r"))
    found = lookup(parts, "_r", dim, dim_key, dim_value, "_x")
    joined = found.groupBy(row_id).agg(F.sort_array(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_x")))).alias("_l"))
    return joined.select(row_id, F.transform("_l", lambda s: s["_x"]).alias(refs))


def chrome_events(spans: DataFrame, t0: Column | float = 0.0) -> DataFrame:
    """Spans ``(time, duration, event, address, pid)`` as trace events with microseconds."""
    return spans.select(
        F.lit("span").alias("cat"), F.col("event").alias("name"), F.col("address").alias("pid"), F.col("pid").alias("tid"),
        ((F.col("time") - t0) * 1e6).cast("long").alias("ts"), (F.col("duration") * 1e6).cast("long").alias("dur"), F.lit("X").alias("ph"),
    )
