"""Aggregations that publish a refined answer after every micro-batch.

T1: a round is a micro-batch of so many files.  T2: after each, the present answer goes to a table of
snapshots.  T4: state lives in the state store.  T5: with a checkpoint, a replayed batch overwrites
its own snapshot, so it counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortkit.functions.divergence import snapshot_divergence
from sortkit.operators.aggregate import shares
from sortkit.plans.lineage import ensure_checkpoint_dir


#: Keys of a line of proportions, on average at most.
KEYS_PER_LINE = 10_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/progressive-{uuid.uuid4().hex}"


def rounds(spark: SparkSession, path: str, schema: str, files_per_round: int, kind: str = "parquet") -> DataFrame:
    """A stream of rounds over the files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_round).format(kind).load(path)


def run_rounds(answer: DataFrame, folder: str, publish: Callable[[DataFrame, int], None] | None = None, rocks: bool = False) -> DataFrame:
    """Run a streaming aggregate over all that is there and give the snapshots, with ``round`` from 0.

    ``publish`` is called with every answer and its round."""
    spark = answer.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if rocks:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/snapshots/round={batch}")
        if publish:
            publish(df, batch)

    try:
        query = answer.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{folder}/snapshots")


def json_proportions(folder: str, key: str, value: str) -> Callable[[DataFrame, int], None]:
    """K8: JSON objects ``{key: share}`` for every round, as lines of a folder.  A line has the keys of one of
    ``ceil(keys / KEYS_PER_LINE)`` hash groups, so few keys give one object and many never gather in a row."""

    def publish(df: DataFrame, batch: int) -> None:
        top = shares(df.select(key, value), value)
        lines = max(1, -(-df.count() // KEYS_PER_LINE))
        one = top.groupBy(F.pmod(F.xxhash64(key), F.lit(lines)).alias("_g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col("share"))))).alias("value"))
        one.select("value").write.mode("overwrite").text(f"{folder}/proportions/round={batch}")

    return publish


def progressive_counts(spark: SparkSession, path: str, schema: str, key: str, files_per_round: int, folder: str | None = None) -> DataFrame:
    """``(round, key, n)``: counts by key after every round."""
    answer = rounds(spark, path, schema, files_per_round).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return run_rounds(answer, folder or shared_folder(spark))


def accuracy(snapshots: DataFrame, key: str, value: str = "n") -> DataFrame:
    """``(round, divergence)`` of every snapshot from the last."""
    last = snapshots.agg(F.max("round")).first()[0]
    totals = snapshots.groupBy("round").agg(F.sum(value).alias("_t"))
    share = snapshots.join(totals, "round").select("round", key, (F.col(value) / F.col("_t")).alias("share"))
    return snapshot_divergence(share, "round", key, "share", last)
