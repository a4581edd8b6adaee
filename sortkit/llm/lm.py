"""Language-model scoring by a trigram model in Elias-Fano tries.

Tokens are words with A-Z lower-cased, and an end for each text.  Texts are dealt to chunks.  A chunk
sends its distinct words, bigrams and trigrams with their counts in training texts to shards by the
hash of their first word; those of a first word, or a first bigram, that begins a large share of all go
by the hash of one word more, so no context gathers in one shard.  A shard adds up the counts and builds a trie of three levels: first words, second words under
each, third words under each of those.  A level is an Elias-Fano sequence of ``parent << 32 | code``,
which makes a lookup a successor search relative to its context; pointers are monotone and implied by
it; frequencies are quantised to a codebook of 255 values.  The trie lies in one buffer that can be
written and memory-mapped.  The shard looks up every chunk's n-grams in its trie and answers with
codes; chunks smooth and add up:

    p1 = (c1 + 1) / (N + V + 1)
    p2 = (c(w1 w2) + M2 p1) / (c(w1) + M2)
    p3 = (c(w1 w2 w3) + M3 p2) / (c(w1 w2) + M3)

which sum to 1 over the V tokens and one unknown.  A text's first token has p1, its second p2.

Defined results: null or empty text is one end token; a null id counts as a training text that isn't
held out; without training texts N = V = 0 and every token has p1 = 1; every row gives a row; rows
with equal ids are scored each for itself; other columns don't matter.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortkit.llm import arrays as A
from sortkit.llm.arrays import expand, join_parts, split_parts, squeeze
from sortkit.llm.common import CHUNK_BYTES, pieces, text_slices, tidy, tidy_batches, tidy_pair, total_bytes

M2, M3 = 8.0, 2.0
#: The end token's hash.
END = np.uint64(0x5EED_E4D0_FFFF_0001)
#: N-grams of a shard, a low guess of the bytes of text for each, and the share of a shard above which a context is split.
SHARD = 1_500_000
BYTES_PER_NGRAM = 4
HEAVY = 0.25
#: Kinds of rows of the first pass, beside the shards' numbers.
HEAVY_WORD, TOKENS, DISTINCT, HEAVY_PAIR = -1, -2, -3, -4


class EliasFano:
    """An ascending sequence of 64-bit values: high parts in unary, low parts in whole bytes."""

    def __init__(self, parts: list[memoryview]):
        self.n, self.low_bits, self.base = struct.unpack("<qqQ", parts[0])
        self.low = np.frombuffer(parts[2], {0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}[self.low_bits])
        # where each run of equal high parts begins: the zeros of the unary code end the runs
        bits = np.unpackbits(np.frombuffer(parts[1], np.uint8))
        zeros = np.flatnonzero(bits == 0)
        self.begin = np.concatenate(([0], zeros - np.arange(len(zeros))))
        self.begin = np.minimum(self.begin, self.n)

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        n = len(values)
        base = int(values[0]) if n else 0
        v = values - np.uint64(base) if n else values
        spread = int(v[-1]) // n if n else 0
        bits = next(b for b in (0, 8, 16, 32, 64) if spread >> b < 8) if n else 0
        high = (v >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
        unary = np.zeros(n + (int(high[-1]) + 1 if n else 1), np.uint8)
        unary[high + np.arange(n)] = 1
        low = v.astype({0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}[bits])
        if bits == 0:
            low = low[:0]
        return join_parts([struct.pack("<qqQ", n, bits, base), np.packbits(unary).tobytes(), low.tobytes()])

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: the run of its high part, then its successor in the run."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        v = values - np.uint64(self.base)
        high = (v >> np.uint64(self.low_bits)) if self.low_bits < 64 else np.zeros(len(v), np.uint64)
        known = (values >= np.uint64(self.base)) & (high < np.uint64(len(self.begin) - 1))
        h = np.where(known, high, np.uint64(0)).astype(np.int64)
        lo, hi = self.begin[h], self.begin[h + 1]
        end = hi
        if self.low_bits == 0:
            return np.where(known & (lo < hi), lo, -1)
        want = v.astype(self.low.dtype)
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            less = self.low[np.minimum(mid, self.n - 1)] < want
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, self.n - 1)
        return np.where(known & (lo < end) & (self.low[at] == want), lo, -1)


def quantise(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 1 and their values (0 stands for no count): every value if they are few, else the means of
    bins of equal width on a log scale."""
    values, of = np.unique(counts, return_inverse=True)
    if len(values) <= 255:
        return (of + 1).astype(np.uint8), np.concatenate(([0.0], values)).astype(np.float64)
    scale = np.log(values)
    bin_ = np.minimum(254, ((scale - scale[0]) / (scale[-1] - scale[0]) * 255).astype(np.int64))
    weight = np.bincount(of)
    total, many = np.bincount(bin_, np.log(values) * weight, 255), np.bincount(bin_, weight, 255)
    return (bin_[of] + 1).astype(np.uint8), np.concatenate(([0.0], np.exp(total / np.maximum(1, many))))


class Trie:
    """A shard: three levels, the first with exact counts.  All parts are views of one buffer."""

    def __init__(self, buffer: bytes | memoryview | mmap.mmap):
        parts = split_parts(buffer)
        self.first, self.second, self.third = (EliasFano(split_parts(p)) for p in parts[:3])
        self.counts = np.frombuffer(parts[3], np.int64)
        self.code2, self.code3 = np.frombuffer(parts[4], np.uint8), np.frombuffer(parts[5], np.uint8)
        self.book2, self.book3 = np.frombuffer(parts[6], np.float64), np.frombuffer(parts[7], np.float64)

    @staticmethod
    def open(path: str) -> Trie:
        """Map a written shard into memory."""
        with open(path, "rb") as f:
            return Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def build(first: np.ndarray, c1: np.ndarray, second: np.ndarray, c2: np.ndarray, third: np.ndarray, c3: np.ndarray) -> bytes:
        (code2, book2), (code3, book3) = quantise(c2), quantise(c3)
        return join_parts([*map(EliasFano.build, (first, second, third)), c1.astype(np.int64).tobytes(), code2.tobytes(), code3.tobytes(), book2.tobytes(), book3.tobytes()])

    def lookup(self, first: np.ndarray, n2: np.ndarray, second: np.ndarray, n3: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact counts of words, and codes of the bigrams and trigrams of a nested list."""

        def pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(at >= 0, values[at], 0).astype(values.dtype) if len(values) else np.zeros(len(at), values.dtype)

        def under(level: EliasFano, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
            return np.where(parent >= 0, level.find(np.maximum(parent, 0).astype(np.uint64) << np.uint64(32) | code), -1)

        p1 = self.first.find(first)
        p2 = under(self.second, np.repeat(p1, n2), second)
        p3 = under(self.third, np.repeat(p2, n3), third)
        return pick(self.counts, p1), pick(self.code2, p2), pick(self.code3, p3)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text with its end, and offsets."""
    h, at = A.hash_texts(texts, lower=True)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def corpus_sizes(docs: DataFrame, n_shards: int, n_ngrams: int) -> tuple[int, int, tuple[np.ndarray, np.ndarray]]:
    """Training tokens, distinct training tokens, and the words and bigrams (hashes) that begin a large share."""
    share = HEAVY * SHARD / max(1, n_ngrams)
    kinds = {HEAVY_WORD: lambda h, ends: h[A.inside(ends, 2)], HEAVY_PAIR: lambda h, ends: A.rolling(h, 2)[A.inside(ends, 2)]}

    def flush(seen: list[np.ndarray], n_tokens: int) -> pa.RecordBatch:
        words = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.uint64)
        shard = (words % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        run = A.starts_of_runs(shard[order])
        g, payload = [TOKENS], [b""]
        for a, b in zip(run.tolist(), [*run[1:].tolist(), len(order)]):
            g.append(int(shard[order[a]]))
            payload.append(A.pack_sorted(words[order[a:b]] // np.uint64(n_shards)))
        return pa.record_batch([pa.array(g, pa.int32()), pa.array(payload, pa.binary()), pa.array([n_tokens] + [0] * (len(g) - 1), pa.int64())], names=["grp", "payload", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size, n_tokens = [], 0, 0
        for batch in batches:
            for rows in text_slices(batch):
                h, ends = tokens([t for t, ok in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()) if ok])
                seen.append(np.unique(h))
                size, n_tokens = size + len(seen[-1]), n_tokens + len(h)
                for kind, keys in kinds.items():
                    key = keys(h, ends)
                    slot = (key >> np.uint64(44)).astype(np.int64)
                    least = max(16.0, share * len(key))
                    values, times = np.unique(key[np.bincount(slot, minlength=1 << 20)[slot] >= least], return_counts=True)
                    many = times >= least
                    if many.any():
                        raw = [v.to_bytes(8, "little") for v in values[many].tolist()]
                        yield pa.record_batch([pa.array([kind] * len(raw), pa.int32()), pa.array(raw, pa.binary()), pa.array(times[many].astype(np.int64))], names=["grp", "payload", "n"])
                if size > 4_000_000:
                    yield flush(seen, n_tokens)
                    seen, size, n_tokens = [], 0, 0
        yield flush(seen, n_tokens)

    def gather(table: pa.Table) -> pa.Table:
        kind, payload, n = table["grp"][0].as_py(), table["payload"].to_pylist(), table["n"].to_numpy()
        if kind == TOKENS:
            payload, n = [b""], [int(n.sum())]
        elif kind >= 0:
            kind, n = DISTINCT, [len(np.unique(np.concatenate([A.unpack_sorted(b) for b in payload])))]
            payload = [b""]
        else:
            values, of = np.unique(np.frombuffer(b"".join(payload), np.uint64), return_inverse=True)
            total = np.bincount(of, n)
            keep = total >= HEAVY * SHARD
            payload, n = [v.to_bytes(8, "little") for v in values[keep].tolist()], total[keep].astype(np.int64)
        return pa.table({"grp": pa.array([kind] * len(payload), pa.int32()), "payload": pa.array(payload, pa.binary()), "n": pa.array(n, pa.int64())})

    schema = "grp int, payload binary, n long"
    found = docs.select("text", "train").mapInArrow(tidy_batches(work), schema).groupBy("grp").applyInArrow(tidy(gather), schema)
    found = found.groupBy("grp", "payload").agg(F.sum("n").alias("n"))  # heavy n-grams, at most n_ngrams / (HEAVY * SHARD) of a kind, and two sums
    rows = found.toArrow().to_pylist()
    sums = {r["grp"]: r["n"] for r in rows if r["grp"] in (TOKENS, DISTINCT)}
    heavy = [np.sort(np.frombuffer(b"".join(r["payload"] for r in rows if r["grp"] == kind), np.uint64)) for kind in kinds]
    return sums.get(TOKENS, 0), sums.get(DISTINCT, 0), (heavy[0], heavy[1])


def _among(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


class Chunk:
    """A chunk's tokens and its distinct words, bigrams and trigrams, the same whenever computed."""

    def __init__(self, table: pa.Table, heavy: tuple[np.ndarray, np.ndarray], n_shards: int):
        self.ids = table["doc_id"].to_pylist()
        train = np.asarray(table["train"].to_pylist(), bool)
        h, self.ends = tokens(table["text"].to_pylist())
        length = np.diff(self.ends)
        train = np.repeat(train, length)
        nth = np.arange(len(h)) - np.repeat(self.ends[:-1], length)
        self.nth = nth
        self.words, self.word = np.unique(h, return_inverse=True)
        size = np.int64(len(self.words))
        self.c1 = np.bincount(self.word, train, size).astype(np.int64)
        has2 = np.flatnonzero(nth >= 1)
        pairs, of, = np.unique(self.word[has2 - 1] * size + self.word[has2], return_inverse=True)
        self.pair = np.full(len(h), -1, np.int64)
        self.pair[has2] = of
        self.c2 = np.bincount(of, train[has2], len(pairs)).astype(np.int64)
        has3 = np.flatnonzero(nth >= 2)
        triples, of = np.unique(self.pair[has3 - 1] * size + self.word[has3], return_inverse=True)
        self.triple = np.full(len(h), -1, np.int64)
        self.triple[has3] = of
        self.c3 = np.bincount(of, train[has3], len(triples)).astype(np.int64)
        self.w1, self.w2 = pairs // size, pairs % size
        context, self.w3 = triples // size, triples % size
        # shards of words, of bigrams by first word or both, of trigrams with their context or by all three
        shards = np.uint64(n_shards)
        home1 = (self.words % shards).astype(np.int64)
        key = A.rolling_pairs(self.words[self.w1], self.words[self.w2])
        home2 = np.where(_among(self.words, heavy[0])[self.w1], (key % shards).astype(np.int64), home1[self.w1])
        hot = _among(key, heavy[1])[context]
        home3 = np.where(hot, (A.mix(key[context] ^ self.words[self.w3]) % shards).astype(np.int64), home2[context])
        # a shard's nodes: what is at home there, and what lies above it
        n1, n2 = np.int64(max(1, len(self.words))), np.int64(max(1, len(pairs)))
        nodes2 = np.unique(np.concatenate((home2 * n2 + np.arange(len(pairs)), np.unique(home3[hot] * n2 + context[hot]))))
        self.shard2, self.node2 = nodes2 // n2, nodes2 % n2
        above = self.shard2 * n1 + self.w1[self.node2]
        nodes1 = np.unique(np.concatenate((home1 * n1 + np.arange(len(self.words)), above)))
        self.shard1, self.node1 = nodes1 // n1, nodes1 % n1
        self.leaf = np.argsort(home3, kind="stable")  # then by context and third word, as they are
        self.shard3 = home3[self.leaf]
        self.n2 = np.bincount(np.searchsorted(nodes1, above), minlength=len(nodes1))
        self.n3 = np.bincount(np.searchsorted(nodes2, self.shard3 * n2 + context[self.leaf]), minlength=len(nodes2))
        self.is_home1, self.is_home2 = home1[self.node1] == self.shard1, home2[self.node2] == self.shard2

    def by_shard(self) -> Iterator[tuple[int, slice, slice, slice]]:
        """Shard; its places in the three levels."""
        shards = np.unique(self.shard1)
        bounds = [np.searchsorted(a, [shards, shards + 1]) for a in (self.shard1, self.shard2, self.shard3)]
        for i, s in enumerate(shards.tolist()):
            yield (s, *(slice(int(b[0][i]), int(b[1][i])) for b in bounds))

    def message(self, a: slice, b: slice, c: slice) -> bytes:
        first, second, third = self.node1[a], self.node2[b], self.leaf[c]
        code = lambda i: (self.words[i] >> np.uint64(32)).astype(np.uint32).tobytes()
        return squeeze([
            A.pack_sorted(self.words[first]), A.pack(np.where(self.is_home1[a], self.c1[first], 0)), A.pack(self.n2[a]),
            code(self.w2[second]), A.pack(np.where(self.is_home2[b], self.c2[second], 0)), A.pack(self.n3[b]),
            code(self.w3[third]), A.pack(self.c3[third]),
        ])


class Message:
    def __init__(self, b: bytes):
        p = expand(b)
        number = lambda i: A.unpack(p[i]).astype(np.int64)
        self.first, self.c1, self.n2 = A.unpack_sorted(p[0]), number(1), number(2)
        self.second, self.c2, self.n3 = np.frombuffer(p[3], np.uint32).astype(np.uint64), number(4), number(5)
        self.third, self.c3 = np.frombuffer(p[6], np.uint32).astype(np.uint64), number(7)


def build_shard(messages: list[Message]) -> bytes:
    """Add up the chunks' counts and lay out the trie of what occurs in training texts."""
    cat = lambda name: np.concatenate([getattr(m, name) for m in messages])
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    first, of1 = np.unique(cat("first"), return_inverse=True)
    c1 = np.bincount(of1, cat("c1"), len(first)).astype(np.int64)
    second, of2 = np.unique(np.repeat(of1, cat("n2")).astype(np.uint64) << half | cat("second"), return_inverse=True)
    c2 = np.bincount(of2, cat("c2"), len(second)).astype(np.int64)
    third, of3 = np.unique(np.repeat(of2, cat("n3")).astype(np.uint64) << half | cat("third"), return_inverse=True)
    c3 = np.bincount(of3, cat("c3"), len(third)).astype(np.int64)
    # drop what has no count, from the leaves up, and number parents anew
    third, c3 = third[c3 > 0], c3[c3 > 0]
    parent = (third >> half).astype(np.int64)
    keep = c2 > 0
    keep[parent] = True
    third = (np.cumsum(keep) - 1)[parent].astype(np.uint64) << half | third & low
    second, c2 = second[keep], c2[keep]
    parent = (second >> half).astype(np.int64)
    keep = c1 > 0
    keep[parent] = True
    second = (np.cumsum(keep) - 1)[parent].astype(np.uint64) << half | second & low
    return Trie.build(first[keep], c1[keep], second, np.maximum(c2, 1), third, c3)


def score(docs: DataFrame, train: Column, *more: Column, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row; ``train`` marks the
    rows to learn from."""
    rows, size = total_bytes(docs, text_col)
    n_ngrams = size // BYTES_PER_NGRAM + rows
    n_shards = pieces(n_ngrams, shard)
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    n, v, heavy = corpus_sizes(marked, n_shards, n_ngrams)
    context = docs.sparkSession.sparkContext.broadcast(heavy)
    n_chunks = pieces(size + 8 * rows, chunk_bytes)
    dealt = marked.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int").alias("chunk"), "doc_id", "text", "train")

    def send(table: pa.Table) -> pa.Table:
        c = Chunk(table, context.value, n_shards)
        g, payload = [], []
        for s, *places in c.by_shard():
            g.append(s)
            payload.append(c.message(*places))
        return pa.table({"grp": pa.array(g, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(g), pa.int32()), "payload": pa.array(payload, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        messages = [Message(b) for b in table["payload"].to_pylist()]
        trie = Trie(build_shard(messages))
        out = []
        for m in messages:
            counts, code2, code3 = trie.lookup(m.first, m.n2, m.second, m.n3, m.third)
            out.append(squeeze([A.pack(counts), code2.tobytes(), code3.tobytes(), trie.book2.tobytes(), trie.book3.tobytes()]))
        return pa.table({"chunk": table["chunk"], "grp": table["grp"], "payload": pa.array(out, pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, types)})
        c = Chunk(table, context.value, n_shards)
        got = dict(zip(answers["grp"].to_pylist(), answers["payload"].to_pylist()))
        c1, c2, c3 = np.zeros(len(c.words)), np.zeros(len(c.w1)), np.zeros(len(c.w3))
        for s, at1, at2, at3 in c.by_shard():
            counts, code2, code3, book2, book3 = expand(got[s])
            home = c.is_home1[at1]
            c1[c.node1[at1][home]] = A.unpack(counts).astype(np.int64)[home]
            home = c.is_home2[at2]
            c2[c.node2[at2][home]] = np.frombuffer(book2)[np.frombuffer(code2, np.uint8)][home]
            c3[c.leaf[at3]] = np.frombuffer(book3)[np.frombuffer(code3, np.uint8)]
        mine = c1[c.word]
        p1 = (mine + 1) / (n + v + 1)
        p = p1.copy()
        i = np.flatnonzero(c.nth >= 1)
        p[i] = (c2[c.pair[i]] + M2 * p1[i]) / (mine[i - 1] + M2)
        j = np.flatnonzero(c.nth >= 2)
        p[j] = (c3[c.triple[j]] + M3 * p[j]) / (c2[c.pair[j - 1]] + M3)
        begin = c.ends[:-1]
        sums = [np.add.reduceat(x, begin) for x in ((mine > 0).astype(np.int64), np.log10(p1), np.log10(p))]
        values = (c.ids, np.diff(c.ends), sums[0], np.full(len(begin), n), sums[1], sums[2])
        return pa.table({k: pa.array(x, t) for k, x, t in zip(names, values, types)})

    by_chunk = dealt.groupBy("chunk")
    sent = by_chunk.applyInArrow(tidy(send), "grp int, chunk int, payload binary")
    answers = sent.groupBy("grp").applyInArrow(tidy(answer), "chunk int, grp int, payload binary")
    out = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(tidy_pair(finish), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
