"""Map, shuffle, reduce with functions of one's own.

Where the functions are sums, counts or the like, ``groupBy().agg()`` says it better and faster; this is
for opaque ones.  ``map_fn`` turns a pandas batch into rows with a ``reducer`` column; ``reduce_fn``
folds a reducer's rows, with the state before them or None, into its new state; ``summary_map_fn`` shortens
a state and ``summary_reduce_fn`` joins the short ones into the answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame

from sortkit.operators.aggregate import top_k
from sortkit.plans.lineage import cut


class Mode(Enum):
    """F4."""

    BATCH = "batch"
    PROGRESSIVE = "progressive"


@dataclass
class MapReduce:
    """``map_schema`` has ``reducer int`` first; ``state_schema`` too.

    ``reduce_fn`` must accept its own states as input rows do: the states of earlier rounds and the new
    rows come as two frames, the first empty at the start."""

    map_fn: Callable[[pd.DataFrame], pd.DataFrame]
    map_schema: str
    reduce_fn: Callable[[pd.DataFrame | None, pd.DataFrame], pd.DataFrame]
    state_schema: str
    summary_map_fn: Callable[[DataFrame], DataFrame] | None = None
    summary_reduce_fn: Callable[[DataFrame], DataFrame] | None = None
    mode: Mode = Mode.BATCH
    summaries: list[tuple[float, DataFrame]] = field(default_factory=list)

    def mapped(self, df: DataFrame) -> DataFrame:
        """the rows that go to reducers."""
        fn = self.map_fn

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield fn(b)

        return df.mapInPandas(work, self.map_schema)

    def reduced(self, rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
        """new states, one frame for each reducer."""
        fn = self.reduce_fn
        if state is None:
            return rows.groupBy("reducer").applyInPandas(lambda new: fn(None, new), self.state_schema)
        both = state.groupBy("reducer").cogroup(rows.groupBy("reducer"))
        return both.applyInPandas(lambda old, new: fn(old if len(old) else None, new), self.state_schema)

    def summary(self, state: DataFrame) -> DataFrame:
        """F3."""
        short = self.summary_map_fn(state) if self.summary_map_fn else state
        return self.summary_reduce_fn(short) if self.summary_reduce_fn else short

    def run(self, *rounds: DataFrame, publish: Callable[[DataFrame, float], None] | None = None) -> DataFrame:
        """the summary of all rounds.  In progressive mode each round's state is carried to the next and
        its summary published with the seconds since the start; otherwise the rounds are one input."""
        if self.mode is Mode.BATCH:
            return self.summary(self.reduced(self.mapped(reduce(DataFrame.unionByName, rounds))))
        began, state = time.monotonic(), None
        for df in rounds:
            state = self.reduced(self.mapped(df), state)
            # a round's state is kept in the shared folder, so later rounds don't compute it again
            state = cut(state)
            if publish:
                publish(self.summary(state), time.monotonic() - began)
        return self.summary(state)


def word_count(n_reducers: int, text: str = "text", k: int | None = None, mode: Mode = Mode.BATCH) -> MapReduce:
    """Word count through the opaque API: ``(word, n)``, or the k most frequent."""

    def map_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        counted = pdf[text].dropna().str.lower().str.split().explode().dropna().value_counts(sort=False)
        out = counted.rename_axis("word").reset_index(name="n")
        out["reducer"] = [ord(w[0]) % n_reducers for w in out["word"]]
        return out[["reducer", "word", "n"]]

    def reduce_fn(state: pd.DataFrame | None, new: pd.DataFrame) -> pd.DataFrame:
        rows = new if state is None else pd.concat([state, new])
        return rows.groupby(["reducer", "word"], as_index=False)["n"].sum()

    schema = "reducer int, word string, n long"
    final = (lambda df: top_k(df, "n", "word", k)) if k else None
    return MapReduce(map_fn, schema, reduce_fn, schema, lambda s: s.select("word", "n"), final, mode)


@contextmanager
def timed(name: str, sink: list[tuple[str, float]] | None = None) -> Iterator[None]:
    """seconds of a block, printed or collected."""
    began = time.monotonic()
    try:
        yield
    finally:
        took = time.monotonic() - began
        sink.append((name, took)) if sink is not None else print(f"{name}: {took:.2f} s")
