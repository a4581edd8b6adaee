"""Partitioned aggregation, top-k, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sortkit.functions.keys import first_char_bucket, split_words
from sortkit.operators.exchange import quantiles


def count_by(df: DataFrame, key: str | Column, name: str = "n", key_name: str = "key") -> DataFrame:
    """A1, A4: rows by key; null keys don't count.  Spark combines before it shuffles."""
    k = (F.col(key) if isinstance(key, str) else key).alias(key_name)
    return df.select(k).where(F.col(key_name).isNotNull()).groupBy(key_name).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, key: str | Column, value: str | Column, name: str = "total", key_name: str = "key") -> DataFrame:
    """A2-A4: sums by key; null keys don't count, and sums of 0 or less are dropped as counters do."""
    k, v = (F.col(x) if isinstance(x, str) else x for x in (key, value))
    rows = df.select(k.alias(key_name), v.alias("_v")).where(F.col(key_name).isNotNull())
    return rows.groupBy(key_name).agg(F.sum("_v").alias(name)).where(F.col(name) > 0)


def word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` of all texts."""
    return docs.select(F.explode(split_words(text)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """O2, O3: the k rows of largest value, ties by key; each partition sends k rows at most."""
    return df.orderBy(F.desc(value), key).limit(k)


def ranked(top: DataFrame, value: str, key: str) -> DataFrame:
    """Ranks from 1 of a small table, such as a result of :func:`top_k`."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), key)).cast("long"))


def top_k_by_bucket(df: DataFrame, bucket: str | Column, value: str, key: str, k: int) -> DataFrame:
    """The k largest in each bucket; rows are cut to k before and after the shuffle."""
    b = (F.col(bucket) if isinstance(bucket, str) else bucket).alias("bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc(value), key)
    return df.select(b, key, value).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def words_by_bucket(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """``(bucket, n_words, n_distinct)`` of words routed by their first character."""
    counted = word_count(docs, text).withColumn("bucket", first_char_bucket("word", n))
    return counted.groupBy("bucket").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def shares(counted: DataFrame, value: str = "n", name: str = "share") -> DataFrame:
    """Each row's share of the total; the total is one row."""
    total = counted.agg(F.sum(value).alias("_t"))
    return counted.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("_t") != 0, F.col(value) / F.col("_t")).otherwise(0.0)).drop("_t")


def span_summary(df: DataFrame, series: str, value: str) -> DataFrame:
    """Median, mean, sample deviation, largest, smallest and count of each series."""
    v = F.col(value)
    out = df.groupBy(series).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("n"))
    middle = quantiles(df, value, [0.5], by=[series]).select(F.col(series).alias("_s"), F.col("value").alias("median"))
    return out.join(middle, F.col(series).eqNullSafe(F.col("_s")), "left").select(series, "median", "mean", "std", "max", "min", "n")


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row of count, mean, deviation, extremes and quartiles."""
    v = F.col(value)
    out = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, value, [0.25, 0.5, 0.75]).agg(*(F.max(F.when(F.col("q") == x, F.col("value"))).alias(f"p{int(100 * x)}") for x in (0.25, 0.5, 0.75)))
    return out.crossJoin(F.broadcast(q)).select("n", "mean", "std", "min", "p25", "p50", "p75", "max")  # one row each


def extremes(df: DataFrame, start: str, end: str, rate: str) -> DataFrame:
    """A10: first start, last end and peak rate."""
    return df.agg(F.min(start).alias("first_start"), F.max(end).alias("last_end"), F.max(rate).alias("peak"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, n)``, bins from 1; 0 and ``bins + 1`` hold what lies outside."""
    b = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long")
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def counters(df: DataFrame, metric: str, delta: str | Column) -> DataFrame:
    """Counters after all increments and decrements."""
    d = F.col(delta) if isinstance(delta, str) else delta
    return df.groupBy(metric).agg(F.sum(d).alias("value"), F.count(F.lit(1)).alias("n_changes"))


def balance(df: DataFrame, part: str | Column | None = None) -> DataFrame:
    """Rows of each partition (physical, or by a column), as a report of skew."""
    p = F.spark_partition_id() if part is None else (F.col(part) if isinstance(part, str) else part)
    return df.groupBy(p.alias("part")).agg(F.count(F.lit(1)).alias("n"))
