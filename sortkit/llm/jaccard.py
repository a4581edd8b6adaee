"""N-gram Jaccard join of whole documents.

A document is its set of five-word shingles.  Documents with equal sets form a class, which takes
part once.  Shingles are ordered from rare to frequent by their exact number of classes; two sets
with a Jaccard index of 0.8 or more must share a shingle among each one's rarest ``n - ceil(0.8 n) + 1``
(the prefix).  Prefix shingles of two or more classes are joined; a pair goes on if its sizes, the
positions of the shared shingle and the counts of 64 hash parts of the sets (a one-step suffix
filter: parts bound the overlap) allow enough overlap; then it is verified once, on the whole sets.

A shingle that few classes have in their prefix gives all their pairs.  Of one that many have, the
classes are first only chained, in an order that differs from shingle to shingle.  What the verified
links connect is one component, and within it no more pairs are needed.  The pairs of such shingles
between different components are then compared in tasks that hold blocks of their sets; only links that
join two components leave a task.  So no link between components is lost, and the pairs of a group of
thousands of near copies don't become rows; its sets go to each pair of its blocks, and each task gives
links of its own, so both still grow with the number of blocks.

Defined results: null or empty text has no shingles and stands alone; fewer than five words form one
shingle; rows with equal ids are one document for components; a null id gets a null component and
links with nothing; every row gives a row; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sortkit.llm import arrays as A
from sortkit.llm.common import CHUNK_BYTES, chunked, cut, pieces, stash, text_slices, tidy, tidy_batches, tidy_pair, total_bytes
from sortkit.llm.components import components

WORDS = 5
#: Least Jaccard index in hundredths.
PERCENT = 80
#: Shingles of a group in which they are counted.
GROUP = 1_500_000
BYTES_PER_SHINGLE = 6
#: A shingle with up to so many classes in its posting list gives all pairs at once.
SMALL = 12
#: Postings in a block of a long list, and shingles of their sets.
BLOCK = 1024
BLOCK_SHINGLES = 500_000
#: So many of a class's prefix shingles are chained.
CHAINED = 12
PARTS = 64
#: Hash parts of the sets that meet in a task.
FINE_PARTS = 256
#: Bits of a shingle by which it is counted; a clash makes it look more frequent, no more.
COUNT_BITS = 44
#: Bits of a shingle by which sets are compared.
SET_BITS = 52


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of shingle hashes, each ascending, concatenated; and offsets."""
    h, at = A.hash_texts(texts, lower=True)
    r = A.rolling(h, words)
    out, size = [], np.zeros(len(texts) + 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            s = np.unique(r[a : b - words + 1]) if b - a >= words else A.rolling(h[a:b], b - a)
            out.append(s)
            size[i + 1] = len(s)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(size)


def signatures(dealt: DataFrame, words: int = WORDS) -> DataFrame:
    """``(chunk, doc_id, n, k1, k2)``: size and 128-bit fingerprint of every row's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 2):
                s, ends = shingle_sets(rows.column(2).to_pylist(), words)
                n = np.diff(ends)
                keys = []
                for salt in (0x1234567, 0x89ABCDEF0123):
                    total = np.concatenate(([np.uint64(0)], np.cumsum(A.mix(s ^ np.uint64(salt)), dtype=np.uint64)))
                    keys.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                del s
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(n, pa.int64()), *map(pa.array, keys)], names=["chunk", "doc_id", "n", "k1", "k2"])

    return dealt.mapInArrow(tidy_batches(work), "chunk int, doc_id long, n long, k1 long, k2 long")


class Chunk:
    """The sets of a chunk's class representatives, and their distinct shingles by counting group."""

    def __init__(self, table: pa.Table, wanted: set[tuple[int, int, int]], n_groups: int, words: int):
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (ids[i], texts[i]))
        node, chosen, before = {k[0] for k in wanted}, [], None
        for i in order:
            if ids[i] in node and (ids[i], texts[i]) != before:
                chosen.append(i)
                before = (ids[i], texts[i])
        self.ids = [ids[i] for i in chosen]
        self.sets, self.ends = shingle_sets([texts[i] for i in chosen], words)
        if len(wanted) < len(chosen):  # an id with several texts: keep the wanted sets
            total = np.concatenate(([np.uint64(0)], np.cumsum(A.mix(self.sets ^ np.uint64(0x1234567)), dtype=np.uint64)))
            key = (total[self.ends[1:]] - total[self.ends[:-1]]).view(np.int64).tolist()
            keep = [i for i in range(len(chosen)) if (self.ids[i], key[i], int(self.ends[i + 1] - self.ends[i])) in wanted]
            parts = [self.sets[self.ends[i] : self.ends[i + 1]] for i in keep]
            self.ids = [self.ids[i] for i in keep]
            self.ends = np.cumsum([0, *map(len, parts)])
            self.sets = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        code = self.sets >> np.uint64(64 - COUNT_BITS)
        self.code, self.of, self.times = np.unique(code, return_inverse=True, return_counts=True)
        self.group = (self.code % np.uint64(n_groups)).astype(np.int64)
        self.order = np.argsort(self.group, kind="stable")
        self.n_groups = np.uint64(n_groups)

    def by_group(self) -> Iterator[tuple[int, np.ndarray]]:
        g = self.group[self.order]
        run = A.starts_of_runs(g)
        for a, b in zip(run.tolist(), [*run[1:].tolist(), len(g)]):
            yield int(g[a]), self.order[a:b]


def add_counts(table: pa.Table) -> pa.Table:
    """Add up a group's counts and give each chunk those above 1 of its shingles, with a bit for each."""
    codes = [A.unpack_sorted(p) for p in table["codes"].to_pylist()]
    times = [A.unpack(p).astype(np.int64) for p in table["times"].to_pylist()]
    code, of = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(of, np.concatenate(times), len(code)).astype(np.int64)[of]
    bits, counts = [], []
    for part in np.split(total, np.cumsum([len(c) for c in codes])[:-1]):
        bits.append(np.packbits(part > 1).tobytes())
        counts.append(A.pack(part[part > 1]))
    return pa.table({"chunk": table["chunk"], "grp": table["grp"], "bits": pa.array(bits, pa.binary()), "counts": pa.array(counts, pa.binary())})


def candidates(docs: DataFrame, id_col: str, text_col: str, words: int, group: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, classes, prefix postings ``(h, node, pos, n)`` and, of the classes with
    postings, ``(node, n, parts, shingles)``."""
    _, size = total_bytes(docs, text_col)
    n_groups = pieces(size // BYTES_PER_SHINGLE, group)
    dealt = chunked(docs, id_col, text_col, pieces(size, chunk_bytes))
    rows = stash(signatures(dealt, words))
    classes = stash(rows.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.min_by("chunk", "doc_id").alias("chunk")))
    wanted = classes.select("chunk", "node", "k1", "n", F.lit(None).cast("int").alias("grp"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("binary").alias("counts"))

    def chosen(table: pa.Table) -> set[tuple[int, int, int]]:
        return {(a, b, c) for a, b, c in zip(table["node"].to_pylist(), table["k1"].to_pylist(), table["n"].to_pylist()) if a is not None}

    def send(table: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"grp": [], "chunk": [], "codes": [], "times": []}
        if table.num_rows and right.num_rows:
            c = Chunk(table, chosen(right), n_groups, words)
            for g, at in c.by_group():
                out["grp"].append(g)
                out["chunk"].append(table["chunk"][0].as_py())
                out["codes"].append(A.pack_sorted(c.code[at] // c.n_groups))
                out["times"].append(A.pack(c.times[at]))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    def prefixes(table: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"h": [], "node": [], "pos": [], "n": [], "parts": [], "shingles": []}
        if table.num_rows and right.num_rows:
            c = Chunk(table, chosen(right), n_groups, words)
            answers = {g: (b, k) for g, b, k in zip(right["grp"].to_pylist(), right["bits"].to_pylist(), right["counts"].to_pylist()) if g is not None}
            df = np.ones(len(c.code), np.int64)
            for g, at in c.by_group():
                bits, counts = answers[g]
                many = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
                df[at[many]] = A.unpack(counts).astype(np.int64)
            df = df[c.of]
            for i, node in enumerate(c.ids):
                a, b = int(c.ends[i]), int(c.ends[i + 1])
                s, d, n = c.sets[a:b], df[a:b], b - a
                length = n - -(-PERCENT * n // 100) + 1
                order = np.lexsort((s, d))[:length]
                pos = np.flatnonzero(d[order] > 1)
                if len(pos):
                    out["h"] += s[order[pos]].view(np.int64).tolist()
                    out["pos"] += pos.tolist()
                    out["node"] += [node] * len(pos)
                    out["n"] += [n] * len(pos)
                    out["parts"] += [None] * len(pos)
                    out["shingles"] += [None] * len(pos)
                    out["h"].append(None)
                    out["pos"].append(None)
                    out["node"].append(node)
                    out["n"].append(n)
                    out["parts"].append(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS).tolist())
                    out["shingles"].append(A.pack_sorted(s >> np.uint64(64 - SET_BITS)))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    by_chunk = dealt.groupBy("chunk")
    sent = by_chunk.cogroup(wanted.groupBy("chunk")).applyInArrow(tidy_pair(send), "grp int, chunk int, codes binary, times binary")
    answers = sent.groupBy("grp").applyInArrow(tidy(add_counts), "chunk int, grp int, bits binary, counts binary")
    right = wanted.unionByName(answers, allowMissingColumns=True)
    both = stash(by_chunk.cogroup(right.groupBy("chunk")).applyInArrow(tidy_pair(prefixes), "h long, node long, pos int, n long, parts array<int>, shingles binary"))
    postings = both.where("h is not null").select("h", "node", "pos", "n")
    nodes = both.where("h is null").select("node", "n", "parts", "shingles")
    return rows, classes, postings, nodes


def allowed(a: str, b: str) -> F.Column:
    """Length and positional filters of two postings of a shingle."""
    need = f"ceil({PERCENT} * ({a}.n + {b}.n) / {100 + PERCENT}D)"
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) and "
        f"1 + least({a}.n - {a}.pos - 1, {b}.n - {b}.pos - 1) >= {need}"
    )


def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(x, y)`` of the pairs whose sets' overlap is enough: parts first, then the sets."""
    need = f"ceil({PERCENT} * (n_x + n_y) / {100 + PERCENT}D)"
    small = nodes.select("node", "n", "parts")
    side = lambda t, k: t.select(*(F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in t.columns))
    close = pairs.distinct().join(side(small, "y"), "y").join(side(small, "x"), "x")
    close = close.where(F.expr(f"aggregate(zip_with(parts_x, parts_y, (a, b) -> least(a, b)), 0, (s, a) -> s + a) >= {need}")).select("x", "y", "n_x", "n_y")
    sets = nodes.select("node", "shingles")
    full = close.join(side(sets, "y"), "y").join(side(sets, "x"), "x").select("x", "y", "shingles_x", "shingles_y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                ok[i] = similar(A.unpack_sorted(b.column(2)[i].as_py()), A.unpack_sorted(b.column(3)[i].as_py()))
            yield pa.record_batch([pa.array(x[ok], pa.int64()), pa.array(y[ok], pa.int64())], names=["x", "y"])

    return full.mapInArrow(tidy_batches(check), "x long, y long")


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles that sets of sizes a and b must share."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two ascending sets link."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    both = int((q[at] == p).sum())
    return 100 * both >= PERCENT * (len(p) + len(q) - both)


class Forest:
    """The sets of a task's nodes, their components, and the links found that join components.  A pair whose ends
    are connected already, or that was compared before, is not compared."""

    def __init__(self, nodes: np.ndarray, packed: list[bytes]):
        self.ids, of = np.unique(nodes, return_inverse=True)
        self.sets: list[list[np.ndarray]] = [[] for _ in self.ids]  # an id may have several texts
        for k, p in zip(of.tolist(), packed):
            self.sets[k].append(A.unpack_sorted(p))
        self.least = np.array([min(map(len, x)) for x in self.sets])
        self.parts = np.zeros((len(self.ids), FINE_PARTS), np.int32)
        width = np.uint64(SET_BITS - FINE_PARTS.bit_length() + 1)
        for k, each in enumerate(self.sets):
            for x in each:
                np.maximum(self.parts[k], np.bincount((x >> width).astype(np.int64), minlength=FINE_PARTS), out=self.parts[k])
        self.label = np.zeros(len(self.ids), np.int64)
        self.compared, self.waiting, self.n_waiting = np.empty(0, np.int64), [], 0
        self.links: list[tuple[int, int]] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        codes = np.unique(np.minimum(x, y) * len(self.ids) + np.maximum(x, y))
        self.waiting.append(codes)
        self.n_waiting += len(codes)
        if self.n_waiting > max(20_000, len(self.compared) // 2):
            self.compare()

    def compare(self) -> None:
        if not self.n_waiting:
            return
        codes = np.unique(np.concatenate(self.waiting))
        self.waiting, self.n_waiting = [], 0
        codes = codes[~np.isin(codes, self.compared, assume_unique=True)]
        self.compared = np.union1d(self.compared, codes)
        x, y = np.divmod(codes, len(self.ids))
        need = least_overlap(self.least[x], self.least[y])
        bound = np.concatenate([np.minimum(self.parts[x[k : k + 4096]], self.parts[y[k : k + 4096]]).sum(1) for k in range(0, len(x), 4096)] or [need])
        likely = np.flatnonzero(bound >= need)
        for k in likely[np.argsort(need[likely] / bound[likely], kind="stable")].tolist():
            a, b = int(x[k]), int(y[k])
            if self.label[a] != self.label[b] and any(similar(p, q) for p in self.sets[a] for q in self.sets[b]):
                self.label[self.label == self.label[b]] = self.label[a]
                self.links.append((int(self.ids[a]), int(self.ids[b])))


def spanning(table: pa.Table, right: pa.Table) -> pa.Table:
    """Links that join the components of a task's blocks; fewer than the task has nodes."""
    links: list[tuple[int, int]] = []
    if table.num_rows and right.num_rows:
        h, i, j, side, node, pos, n, c = (table[k].to_numpy() for k in ("h", "i", "j", "side", "node", "pos", "n", "c"))
        forest = Forest(right["node"].to_numpy(), right["shingles"].to_pylist())
        at = np.searchsorted(forest.ids, node)
        forest.label[at] = c
        order = np.lexsort((j, i, h))
        key = np.stack((h[order], i[order], j[order]))
        run = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
        for a, b in zip(run.tolist(), [*run[1:].tolist(), len(order)]):
            rows = order[a:b]
            if (forest.label[at[rows]] == forest.label[at[rows[0]]]).all():
                continue
            first = rows[side[rows] == i[rows]]
            second = (rows if i[rows[0]] == j[rows[0]] else rows[side[rows] != i[rows]])[None, :]
            for k in range(0, len(first), 256):
                one = first[k : k + 256, None]
                ok = 100 * np.minimum(n[one], n[second]) >= PERCENT * np.maximum(n[one], n[second])
                ok &= np.minimum(n[one] - pos[one], n[second] - pos[second]) >= least_overlap(n[one], n[second])
                ok &= forest.label[at[one]] != forest.label[at[second]]
                p, q = np.nonzero(ok)
                forest.add(at[one[p, 0]], at[second[0, q]])
        forest.compare()
        links = forest.links
    return pa.table({k: pa.array([x[e] for x in links], pa.int64()) for e, k in enumerate(("x", "y"))})


def across(split: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(x, y)``: links of postings ``(h, node, pos, n, c, s, w, key)`` between components c, enough of them to connect
    all components that links connect.

    A list of s postings with w shingles is cut into blocks, and a pair of blocks is compared in one task, on the
    whole sets; pairs don't leave it, links that join its components do.  Block numbers are powers of 2 and lists
    with the same ``key``, the least hash of their nodes, meet in a task, as most of them have the same nodes:
    a set is sent there once, and a pair is compared once."""
    cuts = F.greatest(F.ceil(F.col("s") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES))
    split = stash(split.withColumn("blocks", F.pow(F.lit(2), F.ceil(F.log2(cuts))).cast("int")).drop("s", "w"))
    total = split.agg(F.sum("blocks")).first()[0] or 0
    dealt = split.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("side", "o"), "j": F.greatest("side", "o")})
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(pieces(total, 4 * BLOCK)))).otherwise(F.xxhash64("blocks", "key", "i", "j"))
    dealt = dealt.select(task.alias("g"), "h", "i", "j", "side", "node", "pos", "n", "c")
    there = dealt.select(F.col("g").alias("task"), F.col("node").alias("id")).distinct()
    sets = there.join(nodes.select(F.col("node").alias("id"), "shingles"), "id").select("task", F.col("id").alias("node"), "shingles")
    return dealt.groupBy("g").cogroup(sets.groupBy("task")).applyInArrow(tidy_pair(spanning), "x long, y long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, group: int = GROUP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    rows, classes, postings, nodes = candidates(docs, id_col, text_col, words, group, chunk_bytes)
    sizes = postings.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    listed = stash(postings.join(sizes, "h"))
    small, large = listed.where(F.col("m") <= SMALL), listed.where(F.col("m") > SMALL)
    pairs = small.alias("a").join(small.alias("b"), F.expr("a.h = b.h and a.node < b.node") & allowed("a", "b")).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    # chains: a class's shingles of least hash, so that near copies choose the same ones
    mine = large.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("h"), "h"))).where(F.col("k") <= CHAINED)
    mine = mine.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / 4096)))
    turn = Window.partitionBy("h", "salt").orderBy(F.xxhash64("node", "h"), "node")
    chained = mine.select(F.col("node").alias("p"), F.lag("node").over(turn).alias("q")).where("q is not null and p != q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    first = stash(pairs.unionByName(chained).distinct())
    links = stash(verify(first, nodes))
    found = components(links)
    if not large.isEmpty():
        found = cut(found)
        # pairs of large lists between components
        placed = large.join(found.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        by = placed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"), F.min(F.xxhash64("node")).alias("key"))
        top = by.groupBy("h").agg(F.count(F.lit(1)).alias("cs"), F.sum("k").alias("s"), F.sum("w").alias("w"), F.min("key").alias("key")).where("cs > 1")
        extra = stash(across(placed.join(top.select("h", "s", "w", "key"), "h").select("h", "node", "pos", "n", "c", "s", "w", "key"), nodes))
        if not extra.isEmpty():
            found = components(links.unionByName(extra))
    named = classes.select("k1", "k2", "n", "node").join(found, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component"))
    out = rows.join(named, ["k1", "k2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))
