"""Sizes of a sort job, derived from its configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

GB = 1_000_000_000
RECORD = 100


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def bytes_to_records(n: int) -> int:
    return n // RECORD


@dataclass(frozen=True)
class SortJob:
    """What a sort job is asked to do; everything else follows."""

    total_bytes: int
    input_part_bytes: int
    output_part_bytes: int
    workers: int = 1
    cpus: int = 8
    shards_per_mapper: int = 1
    map_multiplier: float = 1.0
    merge_factor: int = 2
    bounds: str = "uniform"

    @property
    def num_mappers(self) -> int:
        return ceil_div(self.total_bytes, self.input_part_bytes)

    @property
    def input_shard_bytes(self) -> int:
        return self.input_part_bytes // self.shards_per_mapper

    @property
    def map_parallelism(self) -> int:
        return int(self.map_multiplier * self.cpus)

    @property
    def merge_parallelism(self) -> int:
        return self.map_parallelism // self.merge_factor

    @property
    def num_rounds(self) -> int:
        return ceil_div(ceil_div(self.num_mappers, self.workers), self.map_parallelism)

    @property
    def mergers_per_worker(self) -> int:
        return self.num_rounds * self.merge_parallelism

    @property
    def num_reducers(self) -> int:
        return ceil_div(self.total_bytes, self.output_part_bytes)

    @property
    def reducers_per_worker(self) -> int:
        return ceil_div(self.num_reducers, self.workers)

    def apply(self, spark: SparkSession) -> None:
        """Let a session's scans and shuffles have these sizes."""
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(self.input_part_bytes))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(1, self.num_reducers)))
