"""Approximate nearest neighbours by collision counting.

Rows are dealt to blocks of vectors that lie near each other: a tree, fitted on a sample of at most ``SAMPLE``
rows, halves its part at the median of the projection that spreads it most; a leaf that gets more than ``BLOCK``
rows (copies too) is dealt to several blocks by lot.  A block has ``PROJECTIONS`` single Gaussian projections, each
a sorted array.  A query's window in each array is centred on its own projection; its half-width is ``WIDTH / 2``
times a radius (virtual rehashing: a larger radius widens all windows).  A vector's collisions are the arrays in
whose window it lies.  A vector at the radius collides often enough with probability ``PASS``, a nearer one more
often; those that do are verified by exact Euclidean distance in double precision.

A query is first searched in its home block: narrow windows of a fixed number of places give a first k, whose
largest distance is the radius of the second windows.  The distance of the k-th found there is its radius in all
other blocks, which need no search of their own.  A block's projections lie in ranges; a query goes only to
blocks where its windows meet the ranges of as many arrays as a verified vector needs, so no other block can hold
one.  Nearest of all blocks are merged.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null id, take no part; vectors of another length than a query's aren't its candidates; a row whose id
is the query's own isn't its candidate; a query in several rows is searched once, with its row of
least vector; ties go to the smaller id; fewer candidates than k give fewer rows; repeated rows are candidates
each; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sortkit.llm.common import pieces, stash, tidy_batches, tidy_pair
from sortkit.llm.vectors import matrix, usable

K = 10
PROJECTIONS = 160
#: Width of a window for radius 1, and the share of vectors right at the radius that collide often enough.
WIDTH = 1.6
PASS = 0.985
#: Rows of a block, blocks at most (beyond, blocks grow), rows from which the tree is fitted, queries that a task holds.
BLOCK = 8_192
MOST_BLOCKS = 16_384
SAMPLE = 100_000
QUERY_BATCH = 16_384
#: Places on either side of a query in the first windows, and how many of their vectors are verified.
PLACES = 48
FIRST = 256
#: Windows that hold more than one in so many of all places are compared and not listed.
DENSE = 12


def threshold(m: int = PROJECTIONS, width: float = WIDTH, passing: float = PASS) -> int:
    """Collisions that a vector at the window's radius reaches with the wanted probability."""
    p = math.erf(width / 2 / math.sqrt(2))
    low = m
    total = 0.0
    while low > 0 and total < passing:
        total += math.comb(m, low) * p**low * (1 - p) ** (m - low)
        low -= 1
    return max(1, low + 1)


def gaussian(dim: int, m: int = PROJECTIONS, seed: int = 29) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, m))


class Tree:
    """Halves vectors at medians of projections; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.cut = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        self.a = gaussian(sample.shape[1])
        p, leaf = sample @ self.a, np.zeros(len(sample), np.int64)
        for level in range(levels):
            for node in range(1 << level):
                own = p[leaf == node]
                at = (1 << level) + node - 1
                if len(own):
                    self.axis[at] = j = int(own.std(0).argmax())
                    self.cut[at] = np.median(own[:, j])
            leaf = 2 * leaf + (p[np.arange(len(p)), self.axis[(1 << level) + leaf - 1]] >= self.cut[(1 << level) + leaf - 1])

    def leaves(self, vec: np.ndarray) -> np.ndarray:
        p, leaf = vec @ self.a, np.zeros(len(vec), np.int64)
        for level in range(self.levels):
            at = (1 << level) + leaf - 1
            leaf = 2 * leaf + (p[np.arange(len(p)), self.axis[at]] >= self.cut[at])
        return leaf


class Block:
    """A block's vectors and their projections as sorted arrays."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, m: int = PROJECTIONS):
        self.ids, self.vec, self.a, self.m, self.least = ids, vec, gaussian(vec.shape[1], m), m, threshold(m)
        p = np.ascontiguousarray((vec @ self.a).T)
        self.order = np.argsort(p, axis=1)
        self.sorted = np.take_along_axis(p, self.order, 1)
        self.place = np.empty(p.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(len(ids), dtype=self.place.dtype)[None, :], 1)
        self.square = (vec * vec).sum(1)
        self.verified = 0

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in each array (rows) where each query's window begins and ends."""
        lo = np.stack([np.searchsorted(s, at[:, j] - half, "left") for j, s in enumerate(self.sorted)])
        hi = np.stack([np.searchsorted(s, at[:, j] + half, "right") for j, s in enumerate(self.sorted)])
        return lo, hi

    def collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of a query's windows each vector lies in: narrow windows are listed, of wide ones the places are compared."""
        if DENSE * int((hi - lo).sum()) <= self.m * len(self.ids):
            return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, lo.tolist(), hi.tolist())]), minlength=len(self.ids))
        kind = self.place.dtype
        after = self.place - lo[:, None].astype(kind)  # places before the window wrap round to large numbers
        return (after < (hi - lo)[:, None].astype(kind)).view(np.uint8).sum(0, dtype=np.uint16)

    def verify(self, own: int, q: np.ndarray, which: np.ndarray, radius: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Of these vectors all but the query's own that lie within the radius, with their exact distances."""
        which = which[self.ids[which] != own]
        self.verified += len(which)
        if math.isfinite(radius):  # a matrix product tells those beyond, but for its rounding
            square, norm = self.square[which], float(q @ q)
            which = which[square - 2 * (self.vec[which] @ q) + norm <= radius * radius + 1e-9 * (square + norm)]
        d = np.sqrt(((self.vec[which] - q) ** 2).sum(1))
        return which[d <= radius], d[d <= radius]

    def best(self, which: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(d) > k:
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            which, d = which[near], d[near]
        keep = np.lexsort((self.ids[which], d))[:k]
        return which[keep], d[keep]

    def home(self, own: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query, ids, distances)`` of the k nearest found for queries without a bound."""
        n, at = len(self.ids), q @ self.a
        if n <= 2 * FIRST:
            for i in range(len(own)):
                which, d = self.best(*self.verify(own[i], q[i], np.arange(n)), k)
                yield i, self.ids[which], d
            return
        middle = np.stack([np.searchsorted(s, at[:, j]) for j, s in enumerate(self.sorted)])
        first = []
        radius = np.empty(len(own))
        for i in range(len(own)):
            hits = self.collisions(np.maximum(middle[:, i] - PLACES, 0), np.minimum(middle[:, i] + PLACES, n))
            which, d = self.verify(own[i], q[i], np.argpartition(hits, n - FIRST)[n - FIRST :])
            first.append((which, d))
            radius[i] = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
        for i, found in enumerate(self.within(own, q, radius, k, first)):
            yield i, *found

    def within(self, own: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int, first: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each query ids and distances of the k nearest found within its radius."""
        n, at = len(self.ids), q @ self.a
        for b in range(0, len(own), 1024):
            part = slice(b, b + 1024)
            lo, hi = self.windows(at[part], WIDTH / 2 * radius[part])
            for i in range(b, min(b + 1024, len(own))):
                hit = self.collisions(lo[:, i - b], hi[:, i - b]) >= self.least
                if first:
                    hit[first[i][0]] = False
                which, d = self.verify(own[i], q[i], np.flatnonzero(hit) if np.isfinite(radius[i]) else np.arange(n), float(radius[i]))
                if first and np.isfinite(radius[i]):
                    which, d = np.concatenate((first[i][0], which)), np.concatenate((first[i][1], d))
                which, d = self.best(which, d, k)
                yield self.ids[which], d


def _table(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    ids = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
    join = lambda i, t: np.concatenate([f[i] for f in found]).astype(t) if found else np.empty(0, t)
    return pa.table({"query_id": pa.array(ids), "vec_id": pa.array(join(1, np.int64)), "score": pa.array(join(2, np.float64))})


def _search(good: DataFrame, queries: DataFrame, dim: int, n: int, n_q: int, k: int, block: int, batch: int) -> DataFrame:
    """``(query_id, vec_id, score)`` of the nearest found of vectors of one length, before they are merged."""
    spark = good.sparkSession
    block = max(block, -(-n // MOST_BLOCKS))
    levels = max(0, math.ceil(math.log2(max(1, n / block))))
    picked = good.sample(min(1.0, SAMPLE / n), 7).select("embedding").limit(2 * SAMPLE).toArrow() if levels else None
    tree = Tree(matrix(picked["embedding"]).astype(np.float64), levels) if picked is not None and picked.num_rows else Tree(np.zeros((1, dim)), 0)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaves(matrix(b.column(1)).astype(np.float64)) if b.num_rows else np.empty(0, np.int64)
            yield pa.record_batch([*b.columns, pa.array(leaf.astype(np.int32))], names=["vec_id", "embedding", "lot", "leaf"])

    kind = dict(good.dtypes)["embedding"]
    placed = lambda t, lot: stash(t.select("vec_id", "embedding", lot.alias("lot")).mapInArrow(tidy_batches(place), f"vec_id long, embedding {kind}, lot long, leaf int"))
    rows, asked = placed(good, F.xxhash64(F.monotonically_increasing_id())), placed(queries, F.xxhash64("vec_id"))
    # rows and queries of each of at most MOST_BLOCKS leaves
    sizes = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
    asks = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}
    leaves = 1 << tree.levels
    blocks = np.array([pieces(sizes.get(i, 0), 2 * block) for i in range(leaves)])
    begin = np.concatenate(([0], np.cumsum(blocks)))
    # leaves next to each other share a batch of queries; one with many has several
    many = np.array([asks.get(i, 0) for i in range(leaves)])
    group = np.cumsum(many) // batch
    lots = np.array([pieces(int(x), batch) for x in many])
    n_groups = int(lots.max()) * (int(group.max()) + 1)
    layout = spark.createDataFrame([(i, int(begin[i]), int(blocks[i]), int(group[i] * lots.max()), int(lots[i])) for i in range(leaves)], "leaf int, begin int, blocks int, grp int, lots int")
    own_block = (F.col("begin") + F.pmod(F.col("lot"), F.col("blocks"))).cast("int").alias("block")
    rows = rows.join(F.broadcast(layout), "leaf").select(own_block, "vec_id", "embedding")
    asked = asked.join(F.broadcast(layout), "leaf").select(own_block, F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), (F.col("grp") + F.pmod(F.col("lot"), F.col("lots"))).cast("int").alias("batch"))

    def home(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"query_id": right["query_id"], "vec_id": pa.nulls(right.num_rows, pa.int64()), "score": pa.nulls(right.num_rows, pa.float64()), "block": right["block"], "ranges": pa.nulls(right.num_rows, pa.binary())})
        b = Block(left["vec_id"].to_numpy(), matrix(left["embedding"]).astype(np.float64))
        ids = right["query_id"].to_numpy()
        found = [(int(ids[i]), x, d) for i, x, d in b.home(ids, matrix(right["q"]).astype(np.float64), k)] if len(ids) else []
        t = _table(found)
        number = left["block"][0].as_py()
        ranges = np.stack((b.sorted[:, 0], b.sorted[:, -1])).astype(np.float32)
        ranges[0], ranges[1] = np.nextafter(ranges[0], np.float32(-np.inf)), np.nextafter(ranges[1], np.float32(np.inf))
        t = t.append_column("block", pa.array([number] * len(t), pa.int32())).append_column("ranges", pa.nulls(len(t), pa.binary()))
        return pa.concat_tables([t, pa.table({"query_id": pa.nulls(1, pa.int64()), "vec_id": pa.nulls(1, pa.int64()), "score": pa.nulls(1, pa.float64()), "block": pa.array([number], pa.int32()), "ranges": pa.array([ranges.tobytes()], pa.binary())})])

    at_home = stash(rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(tidy_pair(home), "query_id long, vec_id long, score double, block int, ranges binary"))
    found = at_home.where("vec_id is not null").select("query_id", "vec_id", "score")
    if int(begin[-1]) == 1:
        return found
    # at most about 2 * MOST_BLOCKS rows of 8 * PROJECTIONS bytes
    ends = at_home.where("ranges is not null").select("block", "ranges").toArrow()
    known = spark.sparkContext.broadcast((ends["block"].to_numpy(), np.frombuffer(b"".join(ends["ranges"].to_pylist()), np.float32).reshape(-1, 2, PROJECTIONS)))
    bounds = found.groupBy("query_id").agg(F.max("score").alias("radius"), F.count(F.lit(1)).alias("n"))
    bounded = asked.join(bounds, "query_id", "left").select("query_id", "q", "batch", "block", F.when(F.col("n") >= k, F.col("radius")).alias("radius"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ranges = known.value
        a, least = gaussian(dim), threshold()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                r = b.slice(at, 256)
                p = matrix(r.column(1)).astype(np.float64) @ a
                half = WIDTH / 2 * r.column(4).fill_null(float("inf")).to_numpy(zero_copy_only=False)
                meets = np.zeros((len(p), len(number)), np.int16)
                for j in range(PROJECTIONS):
                    meets += (ranges[None, :, 0, j] <= (p[:, j] + half)[:, None]) & (ranges[None, :, 1, j] >= (p[:, j] - half)[:, None])
                i, to = np.nonzero((meets >= least) & (number[None, :] != r.column(3).to_numpy()[:, None]))
                chosen = r.take(pa.array(i))
                yield pa.record_batch([pa.array(number[to].astype(np.int32)), chosen.column(2), chosen.column(0), chosen.column(1), chosen.column(4)], names=["block", "batch", "query_id", "q", "radius"])

    visits = stash(bounded.mapInArrow(tidy_batches(route), f"block int, batch int, query_id long, q {kind}, radius double"))
    if n_groups > 1:
        met = visits.select("block", "batch").distinct()
        rows = rows.join(met, "block")
    else:
        rows = rows.withColumn("batch", F.lit(0))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        b = Block(left["vec_id"].to_numpy(), matrix(left["embedding"]).astype(np.float64))
        ids = right["query_id"].to_numpy()
        radius = right["radius"].combine_chunks().fill_null(float("inf")).to_numpy(zero_copy_only=False)
        near = b.within(ids, matrix(right["q"]).astype(np.float64), radius, k)
        return _table([(int(i), x, d) for i, (x, d) in zip(ids, near)])

    visits = visits.select(F.col("block").alias("to"), F.col("batch").alias("of"), "query_id", "q", "radius")
    away = rows.groupBy("block", "batch").cogroup(visits.groupBy("to", "of")).applyInArrow(tidy_pair(visit), "query_id long, vec_id long, score double")
    return found.unionByName(away)


def search(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, batch: int = QUERY_BATCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest rows found, by Euclidean distance."""
    good = usable(rows, id_col, vec_col)
    queries = usable(rows.where(is_query), id_col, vec_col).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    count = lambda t: {r["d"]: r["n"] for r in t.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n_q = count(good), count(queries)
    found = None
    for d in sorted(n_q):
        of = F.size("embedding") == d
        part = _search(good.where(of), queries.where(of), d, n[d], n_q[d], k, block, batch)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
