"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortkit.llm.common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, x: str = "x", y: str = "y", most: int = 60) -> DataFrame:
    """``(node, component)`` for every node with a link to another; ``component`` is the least node reachable.

    Each step rewrites every edge to point at the least neighbour of one of its ends, which keeps what
    is connected and flattens it to stars in about log steps.  Sums of a node's edges are combined
    before they are shuffled, and a hot node's joins can be split."""
    edges = cut(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u != v").distinct())
    before = None
    for _ in range(most):
        # large star: larger neighbours of u go to the least of u and its neighbours
        near = _both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = cut(small)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
