"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised; a table's code is made of ``k`` quantised Gaussian projections, and vectors
with equal codes in one of ``L`` tables are compared by exact cosine in double precision.  ``k`` grows
with the logarithm of the number of vectors, so that few unlike vectors share a bucket, and ``L``
follows from the wish to find a pair right at the threshold with probability ``RECALL``.

Equal vectors form a class that is hashed once.  What travels to the buckets is a class's code in every
table, with its id and 128 signs of further projections: two classes of a bucket are candidates unless so
many signs differ that a pair at the threshold would do so once in a million times.  Buckets give candidates as spanning
edges, never as pairs.  Connected candidates are then brought together, each vector once, and all their
pairs are compared exactly.  Beyond ``SPLIT`` classes that would be too many pairs: vectors of such a group go to their
buckets instead, where a pair is compared in the first table that has both in a bucket, and a bucket above ``SPLIT``
classes is cut into blocks, each pair of blocks a task of its own.  A bucket that a sample shows to have over
``HOT`` classes is not gathered for candidates: its classes are tied to one of them where they are hashed.

Projections are sums of integers below 2^53, so a code does not depend on how rows are batched.

Defined results: a row with a null id has null component and no links; vectors that are null, empty, zero
or hold null or non-finite components link with nothing and keep themselves; vectors of different
lengths never link; rows with equal ids count as vectors of their own but share a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortkit.llm.common import cut, pieces, release, stash, tidy
from sortkit.llm.components import components
from sortkit.llm.vectors import matrix, usable

THRESHOLD = 0.9
#: Width of a projection's cells for unit vectors.
WIDTH = 2.5
RECALL = 0.97
#: Unlike vectors that a bucket should hold at most on average.
CROWD = 8.0
#: Classes in a bucket above which its pairs are dealt to several tasks; block of the matrix path.
SPLIT = 2_048
SMALL = 24
ROWS_PER_GROUP = 20_000
#: Codes in a task that looks for candidates, and codes made by one call of the hashing.
CODES_PER_GROUP = 500_000
CODES_PER_CALL = 400_000
#: Classes in a bucket above which it isn't gathered, and sampled classes that tell such buckets.
HOT = 1_000_000
HOT_SAMPLE = 200_000
#: Sign bits of a sketch, and the chance that a pair at the threshold is lost by them.
SIGNS = 128
SIGN_LOSS = 1e-6
#: Steps of a unit vector's components and of the projections.
UNIT_STEPS, LINE_STEPS = 1 << 15, 1 << 12


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection is equal for vectors at a distance."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """``k`` and ``L`` for n vectors."""
    near, far = collision(math.sqrt(2 * (1 - threshold))), collision(math.sqrt(2.0))
    k = max(4, math.ceil(math.log(max(2.0, n / CROWD)) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def differing(threshold: float) -> int:
    """Differing signs that a pair at the threshold exceeds with probability below ``SIGN_LOSS``."""
    p, over = math.acos(min(1.0, threshold)) / math.pi, 1.0
    for h in range(SIGNS + 1):
        over -= math.comb(SIGNS, h) * p**h * (1 - p) ** (SIGNS - h)
        if over < SIGN_LOSS:
            return h
    return SIGNS


class Hasher:
    """Codes of vectors of any length; all sums are of integers, exact in any order."""

    def __init__(self, dim: int, k: int, tables: int, seed: int = 17):
        rng = np.random.default_rng([seed, dim])
        self.k, self.tables = k, tables
        self.width = WIDTH * UNIT_STEPS * LINE_STEPS
        self.a = np.rint(rng.normal(size=(dim, k * tables)) * LINE_STEPS)
        self.b = np.rint(rng.uniform(0, self.width, k * tables))
        self.mix = rng.integers(1, 1 << 62, k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.lines = np.rint(rng.normal(size=(dim, SIGNS)) * LINE_STEPS)

    @staticmethod
    def units(vec: np.ndarray) -> np.ndarray:
        big = np.abs(vec).max(1, keepdims=True)
        v = vec / big
        return np.rint(v / np.sqrt((v * v).sum(1, keepdims=True)) * UNIT_STEPS)

    def codes(self, vec: np.ndarray) -> np.ndarray:
        """A 63-bit code of every vector in every table."""
        out = np.empty((len(vec), self.tables), np.int64)
        step = max(1, 1_500_000 // (self.k * self.tables))
        for at in range(0, len(vec), step):
            line = self.units(vec[at : at + step]) @ self.a
            line += self.b
            line /= self.width
            cell = np.floor(line, out=line).astype(np.int64).astype(np.uint64).reshape(-1, self.tables, self.k)
            h = (cell * self.mix).sum(2, dtype=np.uint64)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[at : at + step] = (h >> np.uint64(1)).astype(np.int64)
        return out

    def keys(self, vec: np.ndarray) -> np.ndarray:
        """Codes that tell tables apart too."""
        h = self.codes(vec).astype(np.uint64) + (np.arange(self.tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)

    def signs(self, vec: np.ndarray) -> np.ndarray:
        """The sketch of every vector as words of 64 bits."""
        return np.ascontiguousarray(np.packbits(self.units(vec) @ self.lines >= 0, axis=1)).view(np.uint64)


def local_parts(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number connected with each of n by the links x-y."""
    part = np.arange(n)
    while True:
        low = np.minimum(part[x], part[y])
        new = part.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == part).all():
            return part
        part = new


class _Bucket:
    """Links found in one task's buckets, as counts and edges."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, vec: np.ndarray, codes: np.ndarray, threshold: float):
        self.node, self.weight, self.codes, self.threshold = node, weight, codes, threshold
        # scaled by powers of two, which rounds nothing and keeps squares finite
        self.vec = np.ldexp(vec, -np.frexp(np.abs(vec).max(1))[1][:, None]) if len(vec) else vec
        self.norm = np.sqrt((self.vec * self.vec).sum(1))
        self.links = np.zeros(len(node), np.int64)
        self.x: list[np.ndarray] = []
        self.y: list[np.ndarray] = []

    def pairs(self, x: np.ndarray, y: np.ndarray, table: int) -> None:
        for at in range(0, len(x), 50_000):
            p, q = x[at : at + 50_000], y[at : at + 50_000]
            fresh = ~(self.codes[p, :table] == self.codes[q, :table]).any(1) if table else np.ones(len(p), bool)
            p, q = p[fresh], q[fresh]
            cosine = np.einsum("ij,ij->i", self.vec[p], self.vec[q]) / (self.norm[p] * self.norm[q])
            ok = (cosine >= self.threshold) & (self.node[p] != self.node[q])
            self.add(p[ok], q[ok])

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.links, p, self.weight[q])
        np.add.at(self.links, q, self.weight[p])
        self.x.append(p)
        self.y.append(q)

    def block(self, rows: np.ndarray, cols: np.ndarray, table: int) -> None:
        """All pairs of rows with cols (or of rows among themselves, if they are the same)."""
        same = rows is cols
        for i in range(0, len(rows), 512):
            r = rows[i : i + 512]
            for j in range(i if same else 0, len(cols), 512):
                c = cols[j : j + 512]
                ok = (self.vec[r] @ self.vec[c].T) / (self.norm[r][:, None] * self.norm[c]) >= self.threshold
                ok &= self.node[r][:, None] != self.node[c]
                for t in range(table):
                    if not ok.any():
                        break
                    ok &= self.codes[r, t][:, None] != self.codes[c, t]
                if same and i == j:
                    ok = np.triu(ok, 1)
                self.links[r] += (ok * self.weight[c]).sum(1)
                self.links[c] += (ok * self.weight[r][:, None]).sum(0)
                # a pair's parts, not its pairs: every class with the first one that it is connected with
                p, q = np.nonzero(ok)
                if len(p):
                    part = local_parts(len(r) + len(c), p, q + len(r))
                    both = np.concatenate((r, c))
                    moved = np.flatnonzero(part != np.arange(len(part)))
                    self.x.append(both[moved])
                    self.y.append(both[part[moved]])


def _neighbour_pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions inside small runs, by their distance."""
    for d in range(1, int(size.max()) if len(size) else 1):
        have = size > d
        m = size[have] - d
        first = np.repeat(start[have], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield first, first + d


def candidates(classes: DataFrame, dim: int, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """``(x, y)``: spanning edges of the classes that share a bucket and most signs."""
    k, tables = plan(n, threshold)
    groups, most, split = pieces(n * tables, CODES_PER_GROUP), differing(threshold), SPLIT
    of_dim = classes.where(F.size("embedding") == dim).select("node", "embedding")
    hot_keys, hot_nodes = _hot(of_dim, dim, k, tables, n)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, step = Hasher(dim, k, tables), max(1, CODES_PER_CALL // tables)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                v = matrix(rows.column(1)).astype(np.float64)
                node, sign, key = rows.column(0).to_numpy(), hasher.signs(v), hasher.keys(v).ravel()
                idx = np.repeat(np.arange(len(v), dtype=np.uint32), tables)
                g = key % groups
                if len(hot_keys):
                    # a hot bucket's parts are in many groups, each with the class that ties them
                    pos = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    is_hot = hot_keys[pos] == key
                    g[is_hot] = (g[is_hot] + int(node[0] % groups)) % groups
                    tie = np.unique(pos[is_hot])
                    key = np.concatenate((key, hot_keys[tie]))
                    g = np.concatenate((g, (hot_keys[tie] % groups + int(node[0] % groups)) % groups))
                    idx = np.concatenate((idx, len(node) + np.arange(len(tie), dtype=np.uint32)))
                    node = np.concatenate((node, hot_nodes[tie]))
                    sign = np.concatenate((sign, np.zeros((len(tie), sign.shape[1]), np.uint64)))
                order = np.argsort(g, kind="stable")
                key, idx, g = key[order], idx[order], g[order]
                cut_at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
                out: list[list] = [[], [], [], [], []]
                for a, z in zip(cut_at.tolist(), np.append(cut_at[1:], len(g)).tolist()):
                    own, place = np.unique(idx[a:z], return_inverse=True)
                    parts = (key[a:z], place.astype(np.uint32), node[own], sign[own])
                    for column, value in zip(out, (int(g[a]), *(x.tobytes() for x in parts))):
                        column.append(value)
                yield pa.record_batch([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["g", "k", "i", "node", "s"])
        release()

    def near(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(b, kind) for b in table[name].to_pylist()]
        nodes = read("node", np.int64)
        before = np.cumsum([0, *(len(x) for x in nodes)])
        idx = np.concatenate([x.astype(np.int64) + o for x, o in zip(read("i", np.uint32), before)])
        node, key, sign = np.concatenate(nodes), np.concatenate(read("k", np.int64)), np.concatenate(read("s", np.uint64)).reshape(len(np.concatenate(nodes)), -1)
        order = np.lexsort((node[idx], key))
        key, idx = key[order], idx[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        whole = (size > split) | np.isin(key[start], hot_keys)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        few = ~whole & (size <= SMALL)
        for a, b in _neighbour_pairs(start[few], size[few]):
            for at in range(0, len(a), 500_000):
                p, q = idx[a[at : at + 500_000]], idx[b[at : at + 500_000]]
                ok = np.bitwise_count(sign[p] ^ sign[q]).sum(1, dtype=np.int64) <= most
                found.append((p[ok], q[ok]))
        for a, m, all_ in zip(start[~few].tolist(), size[~few].tolist(), whole[~few].tolist()):
            of = idx[a : a + m]
            if all_:
                found.append((of[1:], np.full(m - 1, of[0])))
                continue
            for i in range(0, m, 512):
                for j in range(i, m, 512):
                    r, c = of[i : i + 512], of[j : j + 512]
                    far = np.zeros((len(r), len(c)), np.int64)
                    for w in range(sign.shape[1]):
                        far += np.bitwise_count(sign[r, w][:, None] ^ sign[c, w])
                    p, q = np.nonzero(far <= most)
                    part = local_parts(len(r) + len(c), p, q + len(r))
                    both, moved = np.concatenate((r, c)), np.flatnonzero(part != np.arange(len(part)))
                    found.append((both[moved], both[part[moved]]))
        # a class that several batches named stands here more than once
        name, own = np.unique(node, return_inverse=True)
        x, y = (own[np.concatenate([f[s] for f in found])] if found else np.empty(0, np.int64) for s in (0, 1))
        part = local_parts(len(name), x, y)
        moved = np.flatnonzero(part != np.arange(len(part)))
        return pa.table({"x": name[moved], "y": name[part[moved]]})

    sent = of_dim.mapInArrow(spread, "g int, k binary, i binary, node binary, s binary")
    return sent.groupBy("g").applyInArrow(tidy(near), "x long, y long")


def _hot(of_dim: DataFrame, dim: int, k: int, tables: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, of the buckets that a sample shows to hold over ``HOT`` classes, and a class of each.
    There are at most ``n * tables / HOT`` such buckets.  What the sample misses only makes a task larger."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if n <= HOT:
        return none
    share = max(1, n // HOT_SAMPLE)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim, k, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                rows = batch.slice(at, 2_000)
                key = hasher.keys(matrix(rows.column(1)).astype(np.float64))
                yield pa.record_batch([pa.array(key.ravel()), pa.array(np.repeat(rows.column(0).to_numpy(), tables))], names=["k", "node"])

    sample = of_dim.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).mapInArrow(codes, "k long, node long")
    held = sample.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("node")).where(F.col("m") * share > HOT).orderBy("k").collect()
    return (np.array([r["k"] for r in held], np.int64), np.array([r["node"] for r in held], np.int64)) if held else none


def within(members: DataFrame, dim: int, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """``(node, n, component)`` of the classes ``(part, node, w, embedding)`` from all exact comparisons inside a part."""

    def compare(table: pa.Table) -> pa.Table:
        part, node = table["part"].to_numpy(), table["node"].to_numpy()
        order = np.lexsort((node, part))
        part, node, weight = part[order], node[order], table["w"].to_numpy()[order]
        vec = matrix(table["embedding"]).astype(np.float64)[order]
        b = _Bucket(node, weight, vec, np.empty((len(node), 0), np.int64), threshold)
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        size = np.diff(np.append(start, len(part)))
        few = size <= SMALL
        for p, q in _neighbour_pairs(start[few], size[few]):
            b.pairs(p, q, 0)
        for a, m in zip(start[~few].tolist(), size[~few].tolist()):
            at = np.arange(a, a + m)
            b.block(at, at, 0)
        x, y = (np.concatenate(e) if e else np.empty(0, np.int64) for e in (b.x, b.y))
        # rows are in order of ids inside a part, so the least row has the least id
        return pa.table({"node": node, "n": b.links, "component": node[local_parts(len(node), x, y)]})

    dealt = members.where(F.size("embedding") == dim).withColumn("g", F.pmod(F.xxhash64("part"), F.lit(pieces(n, ROWS_PER_GROUP))).cast("int"))
    return dealt.groupBy("g").applyInArrow(tidy(compare), "node long, n long, component long")


def links(classes: DataFrame, dim: int, n: int, total: int, threshold: float = THRESHOLD) -> DataFrame:
    """``(x, y, n)`` rows of n classes, hashed as fits ``total``: y null and n counted links of x, or an edge x-y of
    connected classes."""
    k, tables = plan(total, threshold)
    single = dict(classes.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim, k, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                rows = batch.slice(at, 2_000)
                v = matrix(rows.column(2)).astype(np.float64)
                codes = hasher.codes(v)
                raw = [x.tobytes() for x in v.astype(kind)]
                for t in range(tables):
                    yield pa.record_batch([pa.array(np.full(len(v), t, np.int32)), pa.array(codes[:, t]), rows.column(0), rows.column(1), pa.array(raw, pa.binary())], names=["t", "code", "node", "w", "v"])

    rows = classes.where(F.size("embedding") == dim).select("node", "w", "embedding").mapInArrow(spread, "t int, code long, node long, w long, v binary")
    crowded = cut(rows.groupBy("t", "code").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SPLIT))
    groups = pieces(n * tables, ROWS_PER_GROUP)
    if crowded.isEmpty():
        dealt = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    else:
        with_m = rows.join(crowded, ["t", "code"], "left")
        blocks = F.ceil(F.col("m") / SPLIT).cast("int")
        with_side = with_m.withColumn("side", F.when(F.col("m").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), blocks).cast("int")))
        other = F.explode(F.when(F.col("m").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
        dealt = with_side.withColumn("o", other).withColumns({"i": F.least("side", "o"), "j": F.greatest("side", "o")}).drop("o", "m")
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("t", "code", "i", "j"), F.lit(groups)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        column = lambda name: table[name].to_numpy()
        t, code, i, j = (column(c) for c in ("t", "code", "i", "j"))
        order = np.lexsort((column("node"), j, i, code, t))
        vec = np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(-1, dim).astype(np.float64)[order]
        node, weight, side = (column(c)[order] for c in ("node", "w", "side"))
        t, code, i, j = t[order], code[order], i[order], j[order]
        codes = Hasher(dim, k, tables).codes(vec)
        b = _Bucket(node, weight, vec, codes, threshold)
        new = (t[1:] != t[:-1]) | (code[1:] != code[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        run = np.flatnonzero(np.concatenate(([True], new)))
        size = np.diff(np.append(run, len(t)))
        plain = i[run] == j[run]
        for table_no in np.unique(t[run]).tolist():
            of = t[run] == table_no
            # small buckets of a table together
            few = of & plain & (size <= SMALL)
            for p, q in _neighbour_pairs(run[few], size[few]):
                b.pairs(p, q, table_no)
            for r, m_, p in zip(run[of & ~few], size[of & ~few], plain[of & ~few]):
                at = np.arange(r, r + m_)
                if p:
                    b.block(at, at, table_no)
                else:
                    left = side[at] == i[r]
                    b.block(at[left], at[~left], table_no)
        some = np.flatnonzero(b.links)
        x = np.concatenate(b.x) if b.x else np.empty(0, np.int64)
        y = np.concatenate(b.y) if b.y else np.empty(0, np.int64)
        return pa.table({
            "x": pa.array(np.concatenate((node[some], node[x]))),
            "y": pa.array(np.concatenate((np.zeros(len(some), np.int64), node[y])), mask=np.concatenate((np.ones(len(some), bool), np.zeros(len(y), bool)))),
            "n": pa.array(np.concatenate((b.links[some], np.zeros(len(x), np.int64)))),
        })

    return dealt.groupBy("g").applyInArrow(compare, "x long, y long, n long")


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    good = usable(rows, id_col, vec_col)
    classes = stash(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("w")))
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    edges = union(candidates(classes, dim, n, threshold) for dim, n in sorted(sizes.items()))
    parts = stash(components(edges).withColumnRenamed("component", "part"))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    large = cut(counts.where(F.col("m") > SPLIT))
    small = parts.join(large, "part", "left_anti").join(classes, "node")
    alike = {r["d"]: r["n"] for r in small.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = [within(small, dim, n, threshold) for dim, n in sorted(alike.items())]
    if not large.isEmpty():
        crowd = stash(parts.join(large, "part", "left_semi").join(classes, "node").drop("part"))
        many = {r["d"]: r["n"] for r in crowd.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        found = stash(union(links(crowd, dim, n, sizes[dim], threshold) for dim, n in sorted(many.items())))
        placed.append(found.where("y is null").select(F.col("x").alias("node"), "n", F.col("x").alias("component")))
        placed.append(components(found.where("y is not null").select("x", "y")).select("node", F.lit(0).cast("long").alias("n"), "component"))
    if not placed:
        placed.append(classes.limit(0).select("node", F.col("w").alias("n"), F.col("node").alias("component")))
    known = union(placed).groupBy("node").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    named = classes.join(known, "node", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    seen = usable(rows, id_col, vec_col).join(named, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(_is_usable(vec_col), F.lit(False)) | F.col(id_col).isNull())
    rest = rest.select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    out = seen.unionByName(rest)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _is_usable(vec_col: str) -> F.Column:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
