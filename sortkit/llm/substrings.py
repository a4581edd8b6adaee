"""Substring dedup: passages of 13 words or more that stand in an earlier document are removed.

The suffixes of all texts, as word sequences, are split by prefixes of variable length: a prefix
that begins more suffixes than a group may hold is lengthened by a word, again and again, so that
each group of suffixes fits in memory.  A group sorts its suffixes by their words, takes the lengths of the
prefixes that neighbours share, and so has the subtree of the suffix tree, cut at depth 13.  An internal node at
depth 13 with leaves in several documents is a maximal repeat as far as the tree goes; a leaf whose node has a
leaf of an earlier document loses its words.  Repeats that follow each other along a text join into ``spans``.

Only suffixes that can be leaves of such a node go to the subtrees with their words.  The others are told before: each
text chunk sends short fingerprints of its distinct 13-word beginnings, split by the same prefixes, and learns
which of them another chunk has too.  The fingerprints' length grows with the number of suffixes, so that at most
about one in 65,000 is taken for another's; such a suffix becomes a leaf of its own in the tree, where words are compared.

Texts are dealt to chunks.  A chunk sends each of its distinct windows once, with its earliest
document there, so a passage that a third of all documents share makes one leaf for each chunk.  A
group answers with one bit for each leaf; chunks find their windows again by computing them anew.

Defined results: null text has no words; a document id that is null counts as larger than any other;
rows with equal ids are one document's parts and don't remove each other's words; texts shorter than
13 words stay whole; every row gives a row; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortkit.llm import arrays as A
from sortkit.llm.common import CHUNK_BYTES, chunked, pieces, stash, text_slices, tidy, tidy_batches, tidy_pair, total_bytes

#: Words in a window.
DEPTH = 13
#: Suffixes that a group may hold.
GROUP = 1_000_000
#: Prefix lengths in words, from the shortest.
LENGTHS = (1, 2, 3, 4, 6, 9, DEPTH)
#: Bits of a fingerprint beyond those that number all suffixes.
SPARE_BITS = 16
#: Shared suffixes, with their words, of a subtree on average.
TREE = 500_000
#: Bytes of text for each suffix, a low guess, to set the number of groups.
BYTES_PER_SUFFIX = 6
#: Rows of words that are compared or laid out at a time.
ROWS = 20_000
NO_ID = np.iinfo(np.int64).max


def heavy_prefixes(docs: DataFrame, n_suffixes: int, group: int) -> list[np.ndarray]:
    """By length, the prefixes that begin over half a group's suffixes: those of a batch that begin their
    share of it are counted, so there are at most ``2 * n_suffixes / group`` of a length."""
    share = group / 2 / max(1, n_suffixes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                texts = [t or b"" for t in rows.column(0).to_pylist()]
                h, offsets = A.hash_texts(texts)
                start = A.inside(offsets, DEPTH)
                n = len(start)
                least = max(8.0, share * n)
                level, prefix, times = [], [], []
                for depth, k in enumerate(LENGTHS[:-1]):
                    if not len(start):
                        break
                    p = A.rolling(h, k)[start]
                    slot = (p >> np.uint64(44)).astype(np.int64)
                    maybe = np.bincount(slot, minlength=1 << 20)[slot] >= least
                    values, of, c = np.unique(p[maybe], return_inverse=True, return_counts=True)
                    keep = c >= least
                    level += [depth] * int(keep.sum())
                    prefix += values[keep].view(np.int64).tolist()
                    times += c[keep].tolist()
                    start = start[maybe][keep[of]]
                yield pa.record_batch([pa.array(level, pa.int32()), pa.array(prefix, pa.int64()), pa.array(times, pa.int64())], names=["level", "prefix", "n"])

    found = docs.select(F.col("text")).mapInArrow(tidy_batches(count), "level int, prefix long, n long").groupBy("level", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= group / 4)
    rows = found.orderBy("level", F.desc("n")).limit(len(LENGTHS) * (4 * n_suffixes // group + 4)).toArrow()
    level, prefix = rows["level"].to_numpy(), rows["prefix"].to_numpy()
    return [np.sort(prefix[level == i].view(np.uint64)) for i in range(len(LENGTHS) - 1)]


def groups_of(h: np.ndarray, start: np.ndarray, heavy: list[np.ndarray], n_groups: int) -> np.ndarray:
    """The group of each suffix, by its shortest prefix that isn't heavy."""
    out = np.zeros(len(start), np.int32)
    left = np.arange(len(start), dtype=start.dtype)
    for depth, k in enumerate(LENGTHS):
        p = A.rolling(h, k)[start[left]] if len(left) else np.empty(0, np.uint64)
        out[left] = (A.mix(p + np.uint64(k)) % np.uint64(n_groups)).astype(np.int32)
        if depth == len(LENGTHS) - 1 or not len(heavy[depth]):
            break
        at = np.minimum(np.searchsorted(heavy[depth], p), len(heavy[depth]) - 1)
        left = left[heavy[depth][at] == p]
        if not len(left):
            break
    return out


def spans_of(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Groups and their places in an ascending array."""
    run = A.starts_of_runs(group)
    for a, b in zip(run.tolist(), [*run[1:].tolist(), len(group)]):
        yield int(group[a]), slice(a, b)


class Chunk:
    """The windows of a chunk's texts, the same whenever computed.  A leaf is a distinct fingerprint; leaves are in order
    of their group and fingerprint."""

    def __init__(self, table: pa.Table, heavy: list[np.ndarray], n_groups: int, bits: int, depth: int = DEPTH):
        ids = table["doc_id"].to_pylist()
        texts = table["text"].to_pylist()
        key = np.array([NO_ID if i is None else i for i in ids], np.int64)
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, key[i], texts[i]))
        self.rows, self.depth, self.heavy = order, depth, heavy
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.key, self.none = key[order], np.array([ids[i] is None for i in order], bool)
        self.h, self.offsets = A.hash_texts(self.texts)
        small = np.int32 if len(self.h) < 1 << 31 else np.int64
        self.start = A.inside(self.offsets, depth).astype(small)
        window = A.rolling(self.h, depth)[self.start] >> np.uint64(64 - bits) if len(self.start) else np.empty(0, np.uint64)
        group = groups_of(self.h, self.start, heavy, n_groups)
        if bits + int(n_groups).bit_length() <= 64:
            window |= group.astype(np.uint64) << np.uint64(bits)
            del group
            order = np.argsort(window)
            window = window[order]
            run = A.starts_of_runs(window)
            self.leaf_group = (window[run] >> np.uint64(bits)).astype(np.int32)
            self.leaf_window = window[run] & np.uint64((1 << bits) - 1)
        else:
            order = np.lexsort((window, group))
            window, group = window[order], group[order]
            run = np.flatnonzero(np.concatenate(([True], (window[1:] != window[:-1]) | (group[1:] != group[:-1])))) if len(order) else np.empty(0, np.int64)
            self.leaf_group, self.leaf_window = group[run], window[run]
        del window
        self.doc = (np.searchsorted(self.offsets, self.start, side="right") - 1).astype(small)
        self.leaf = np.empty(len(order), small)
        self.leaf[order] = np.repeat(np.arange(len(run), dtype=small), np.diff(np.append(run, len(order))))
        # texts are in order of their ids, so a leaf's first and last windows have its least and largest
        self.several = self.earlier(self.doc[np.minimum.reduceat(order, run)], self.doc[np.maximum.reduceat(order, run)]) if len(run) else np.empty(0, bool)

    def earlier(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether documents a come before documents b; rows without an id come last and are one document."""
        return (self.key[a] < self.key[b]) & ~self.none[a] | self.none[b] & ~self.none[a]

    def shared(self, bits: dict[int, bytes]) -> np.ndarray:
        """Leaves that stand in several documents, as far as fingerprints tell: here, or by the groups' answers."""
        out = self.several.copy()
        for g, s in spans_of(self.leaf_group):
            out[s] |= np.unpackbits(np.frombuffer(bits[g], np.uint8), count=s.stop - s.start).astype(bool)
        return out

    def suffixes(self, shared: np.ndarray, n_groups: int, words: bool = True) -> Suffixes:
        return Suffixes(self, np.flatnonzero(shared[self.leaf]) if len(shared) else np.empty(0, np.int64), n_groups, words)


class Suffixes:
    """The windows of shared leaves with their words: ``node`` numbers the distinct ones, which are in order of their group.

    Without ``words`` it is known that no two windows of a leaf differ, and the words aren't looked at."""

    def __init__(self, c: Chunk, which: np.ndarray, n_groups: int, words: bool = True):
        self.which = which[np.argsort(c.leaf[which], kind="stable")]
        run = A.starts_of_runs(c.leaf[self.which])
        node = np.repeat(np.arange(len(run), dtype=c.leaf.dtype), np.diff(np.append(run, len(which))))
        first, word, self.clash = run, None, False
        begin = c.start[self.which]
        if words and len(which):
            number: dict[bytes, int] = {}
            word = np.fromiter((number.setdefault(w, len(number)) for t in c.texts for w in t.split()), np.int32, len(c.h))
            self.words = list(number)
            # other words under the same fingerprint are nodes of their own; looked at in blocks of rows
            leaf, differs = begin[run][node], np.zeros(len(which), bool)
            for i in range(0, len(which), ROWS):
                at = slice(i, i + ROWS)
                differs[at] = (word[begin[at][:, None] + np.arange(c.depth)] != word[leaf[at][:, None] + np.arange(c.depth)]).any(1)
            other = np.flatnonzero(differs)
            del leaf, differs
            self.clash = bool(len(other))
        if self.clash:
            _, at, of = np.unique(word[begin[other][:, None] + np.arange(c.depth)], axis=0, return_index=True, return_inverse=True)
            node[other] = len(run) + of.ravel()
            first = np.concatenate((run, other[at]))
        group = groups_of(c.h, c.start[self.which[first]], c.heavy, n_groups)
        by_group = np.argsort(group, kind="stable")
        place = np.empty(len(first), c.leaf.dtype)
        place[by_group] = np.arange(len(first))
        self.group, self.node = group[by_group], place[node]
        begin = begin[first[by_group]]
        self.row = np.empty((len(first), 0 if word is None else c.depth), np.int32)
        for i in range(0, len(first) if word is not None else 0, ROWS):
            self.row[i : i + ROWS] = word[begin[i : i + ROWS][:, None] + np.arange(c.depth)]
        self.doc = c.doc[self.which[first[by_group]]]

    def message(self, c: Chunk, s: slice) -> bytes:
        """The nodes' words as numbers of their own list, from frequent to rare, and their documents' ids."""
        times = np.bincount(self.row[s].ravel(), minlength=len(self.words))
        used = np.flatnonzero(times)
        used = used[np.argsort(-times[used], kind="stable")]
        rank = np.empty(len(self.words), np.uint16 if len(used) < 1 << 16 else np.uint32)
        rank[used] = np.arange(len(used))
        number = rank[self.row[s]]
        docs, at = np.unique(self.doc[s], return_inverse=True)
        planes = number.T.copy().view(np.uint8).reshape(-1, number.dtype.itemsize).T.copy()
        return A.squeeze([b" ".join(self.words[i] for i in used.tolist()), bytes([number.dtype.itemsize]), planes.tobytes(), c.key[docs].tobytes(), c.none[docs].tobytes(), A.pack(at)])


def read_message(b: bytes, number: dict[bytes, int], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, by their numbers in the group, ids and whether there is none, of a message's suffixes."""
    words, width, planes, key, none, at = A.expand(b)
    mine = np.fromiter((number.setdefault(w, len(number)) for w in words.split(b" ")), np.int32)
    local = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width[0], -1).T).view(np.uint16 if width[0] == 2 else np.uint32)
    at = A.unpack(at).astype(np.int64)
    return mine[local.reshape(depth, -1).T], np.frombuffer(key, np.int64)[at], np.frombuffer(none, bool)[at]


class Subtree:
    """Suffixes under a group's prefixes, sorted by their words; ``lcp`` is how many words a suffix shares with the one before."""

    def __init__(self, rows: np.ndarray):
        # several words' numbers side by side in one sort key, as many as fit
        width = max(1, int(rows.max()).bit_length()) if rows.size else 1
        each = 63 // width
        keys = []
        for at in range(0, rows.shape[1], each):
            key = np.zeros(len(rows), np.int64)
            for column in rows.T[at : at + each]:
                key = key << width | column
            keys.append(key)
        self.order = np.lexsort(keys[::-1])
        del keys
        self.lcp = np.zeros(len(rows), np.int32)
        for at in range(1, len(rows), ROWS):
            part = rows[self.order[at - 1 : at + ROWS]]
            differs = part[1:] != part[:-1]
            self.lcp[at : at + ROWS] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, in the order, of the leaves below each node that is ``depth`` words deep or is the end of an edge
        that passes this depth; single leaves too."""
        begin = np.flatnonzero(self.lcp < depth)
        return begin, np.append(begin[1:], len(self.lcp))

    def earlier(self, key: np.ndarray, none: np.ndarray, depth: int) -> np.ndarray:
        """Whether a leaf's node at this depth has a leaf of a document with a smaller id."""
        out = np.zeros(len(key), bool)
        begin, end = self.nodes(depth)
        if len(begin):
            key, none = np.where(none, NO_ID, key)[self.order], none[self.order]
            some = np.repeat(np.logical_or.reduceat(~none, begin), end - begin)
            least = np.repeat(np.minimum.reduceat(key, begin), end - begin)
            out[self.order] = np.where(none, some, least < key)
        return out


def cover(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = (), group: int = GROUP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept, spans][, <carry>])`` of every row; ``kept`` is the kept
    words joined by one space, or the text as it was if all are kept; ``spans`` the removed maximal
    repeats as word ranges [begin, end); ``carry`` names further columns of ``docs`` to pass on."""
    rows, size = total_bytes(docs, text_col)
    n_suffixes = max(1, size // BYTES_PER_SUFFIX)
    n_groups = pieces(n_suffixes, group)
    bits = min(64, math.ceil(math.log2(n_suffixes + 1)) + SPARE_BITS)
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    context = docs.sparkSession.sparkContext.broadcast(heavy_prefixes(texts, n_suffixes, group))
    inner = [f"carry_{i}" for i in range(len(carry))]
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(inner, carry)]
    dealt = chunked(docs, id_col, text_col, pieces(size, chunk_bytes), *(F.col(c).alias(n) for c, n in zip(carry, inner)))

    def send(table: pa.Table) -> pa.Table:
        c = Chunk(table, context.value, n_groups, bits)
        groups, payload, several = [], [], []
        for g, s in spans_of(c.leaf_group):
            groups.append(g)
            payload.append(A.pack_sorted(c.leaf_window[s]))
            several.append(int(c.several[s].sum()))
        return pa.table({"grp": pa.array(groups, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(groups), pa.int32()), "n": pa.array(several, pa.int64()), "payload": pa.array(payload, pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        """Which of each chunk's fingerprints another chunk has; ``n``: how many leaves are shared, at most."""
        sides = [A.unpack_sorted(p) for p in table["payload"].to_pylist()]
        values, of, times = np.unique(np.concatenate(sides), return_inverse=True, return_counts=True)
        del values
        parts = np.split((times > 1)[of], np.cumsum([len(x) for x in sides])[:-1])
        n = table["n"].to_numpy() + [int(x.sum()) for x in parts]
        return pa.table({"chunk": table["chunk"], "grp": table["grp"], "tree": pa.array([False] * len(sides)), "clash": pa.array([False] * len(sides)), "n": pa.array(n, pa.int64()), "bits": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})

    def answered(answers: pa.Table, tree: bool) -> dict[int, bytes]:
        return {g: b for g, t, b in zip(answers["grp"].to_pylist(), answers["tree"].to_pylist(), answers["bits"].to_pylist()) if t == tree}

    def send_suffixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        groups, payload, clash = [], [], False
        if table.num_rows:
            c = Chunk(table, context.value, n_groups, bits)
            x = c.suffixes(c.shared(answered(answers, False)), n_trees)
            clash = x.clash
            for g, s in spans_of(x.group):
                groups.append(g)
                payload.append(x.message(c, s))
        number = table["chunk"][0].as_py() if table.num_rows else 0
        return pa.table({"grp": pa.array(groups, pa.int32()), "chunk": pa.array([number] * len(groups), pa.int32()), "clash": pa.array([clash] * len(groups), pa.bool_()), "payload": pa.array(payload, pa.binary())})

    def grow(table: pa.Table) -> pa.Table:
        """Build a group's subtree; a bit for each leaf whose deep node has one of an earlier document."""
        number: dict[bytes, int] = {}
        sides = [read_message(p.as_py(), number) for p in table["payload"]]
        del number
        key, none = (np.concatenate([s[i] for s in sides]) for i in (1, 2))
        sizes = [len(s[1]) for s in sides]
        sides = [s[0] for s in sides]
        rows, at = np.empty((len(key), DEPTH), np.int32), 0
        for i, n in enumerate(sizes):
            rows[at : at + n], sides[i] = sides[i], None
            at += n
        hit = Subtree(rows).earlier(key, none, DEPTH)
        parts = np.split(hit, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": table["chunk"], "grp": table["grp"], "tree": pa.array([True] * len(sizes)), "clash": table["clash"], "n": pa.array([0] * len(sizes), pa.int64()), "bits": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept", "spans"] * with_text
        out: dict[str, list] = {n: [] for n in names}
        passed = [table[n] for n in inner]
        if table.num_rows:
            c = Chunk(table, context.value, n_groups, bits)
            passed = [table[n].take(pa.array(c.rows)) for n in inner]
            x = c.suffixes(c.shared(answered(answers, False)), n_trees, any(answers["clash"].to_pylist()))
            trees = answered(answers, True)
            far = np.zeros(len(x.group), bool)
            for g, s in spans_of(x.group):
                far[s] = np.unpackbits(np.frombuffer(trees[g], np.uint8), count=s.stop - s.start).astype(bool)
            # repeated elsewhere by an earlier document, or here by one with a smaller id
            hit = np.zeros(len(c.start), bool)
            hit[x.which] = far[x.node] | c.earlier(x.doc[x.node], c.doc[x.which])
            change = np.zeros(int(c.offsets[-1]) + 1, np.int64)
            begins = c.start[hit]
            np.add.at(change, begins, 1)
            np.add.at(change, begins + DEPTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i, text in enumerate(c.texts):
                a, b = int(c.offsets[i]), int(c.offsets[i + 1])
                words, g = text.split(), gone[a:b]
                n = int(g.sum())
                kept = b" ".join(compress(words, (~g).tolist()) if n else words)
                out["doc_id"].append(c.ids[i])
                out["n_words"].append(b - a)
                out["n_removed"].append(n)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                    out["kept"].append((kept if n else text).decode("utf-8", "replace"))
                    out["spans"].append([{"begin": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string(), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))}
        return pa.table({n: pa.array(v, types[n]) for n, v in out.items()} | dict(zip(inner, passed)))

    by_chunk = lambda t: t.groupBy("chunk")
    sent = by_chunk(dealt).applyInArrow(tidy(send), "grp int, chunk int, n long, payload binary")
    known = stash(sent.groupBy("grp").applyInArrow(tidy(compare), "chunk int, grp int, tree boolean, clash boolean, n long, bits binary"))
    n_trees = pieces(int(known.agg(F.sum("n")).first()[0] or 0), min(TREE, group))
    suffixes = by_chunk(dealt).cogroup(by_chunk(known)).applyInArrow(tidy_pair(send_suffixes), "grp int, chunk int, clash boolean, payload binary")
    answers = suffixes.groupBy("grp").applyInArrow(tidy(grow), "chunk int, grp int, tree boolean, clash boolean, n long, bits binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<struct<begin: long, end: long>>" * with_text + "".join(f", {k}" for k in kinds)
    out = by_chunk(dealt).cogroup(by_chunk(known.unionByName(answers))).applyInArrow(tidy_pair(finish), schema)
    return out.toDF(id_col, *out.columns[1 : len(out.columns) - len(carry)], *carry)


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS d FROM starts GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j
  FROM starts JOIN firsts USING (s) WHERE d < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS t, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
