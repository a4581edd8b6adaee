"""Common ground of the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, embedding)`` of the rows with an id and a vector that isn't null, empty or zero and holds
    neither null nor non-finite components."""
    v = F.col(vec_col)
    inf = F.lit(float("inf"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
