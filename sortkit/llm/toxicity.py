"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all whole words of a text, of any length and hashed (ASCII letters lower-cased), and, for scripts
without spaces, the pairs of neighbouring characters of three bytes.  The examples, a bounded sample of
labelled rows, are indexed under all terms of their whole texts.  Terms that labels mark (whole ones, or word
beginnings of 4, 5 and 6 bytes: present in enough toxic examples, there many times as often as in the others,
and needed to explain examples that no other term does) are an addition: their part of a vector is scaled to
``MARKS`` times the rest.  IDF weights count all documents.  Terms that no example has would scale all cosines
of a text alike and are left out.  Examples lie in blocks with the largest weight of every frequent term; a query skips blocks
whose upper bound can't reach its nearest k.  The neighbours' votes, weighted by a
power of similarity, are calibrated by a logistic curve fitted on the examples themselves, each once left out of
its own neighbours and once taken for a copy of itself.

Defined results: a text without any term of an example (null or empty too) is like no example
and gets the toxic share of such examples, below 0.5; rows with a null label aren't learned from;
an example labelled twice counts as toxic if any label says so; without both labels, score is 0.
Every row gives a row; ties go to the smaller number of the example.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortkit.llm.common import cut, release, text_slices, tidy_batches

#: Bound of the sample of labelled rows.
EXAMPLES_PER_LABEL = 3_000
#: A term is a mark if its toxic rate, counted low, is at least so many times its other rate, counted high.
RATIO = 12.0
#: In choosing terms: the share of toxic examples that each must add, the share that is enough whatever
#: others explain, and the price of an example that isn't toxic.
LEAST_GAIN = 0.005
STRONG = 0.05
FINE = 5.0
NEIGHBOURS = 16
BLOCK = 64
SIZES = (4, 5, 6)
PAIR = 7
#: Terms that have a column of their own, and the error of single precision that a cosine stays below.
COLUMNS = 1_024
SLACK = 1e-4
#: Length of the marks' part of a vector (1: the other terms' part), and the power of cosines in votes.
MARKS = 2.0
SHARPNESS = 4
#: Weight of a vote for neither label beside the neighbours' (the nearest has 1).
DOUBT = 0.25
#: Texts and bytes of text scored together.
TOGETHER = 200
#: Postings added up at a time.
POSTINGS = 500_000
TOGETHER_BYTES = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _LETTER[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, term)`` for every occurrence of a term in the texts.  The top byte tells kinds apart: a beginning is
    its bytes as a little-endian number under its length, a pair of characters is its six bytes under ``PAIR``, and a
    whole word is a 63-bit hash of all its bytes under the top bit."""
    joined = b"\0".join([b"", *texts, b"\0" * 9])
    raw = np.frombuffer(joined, np.uint8)
    letter = _LETTER[raw]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    length = end - start
    low = _LOWER[raw]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) + 1
    owner = np.searchsorted(ends, start, side="right")
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owners, out = [], []
    for k in SIZES:
        long = length > k
        at = start[long]
        word = np.full(len(at), k << 56, np.uint64)
        for j in range(k):
            word |= low[at + j].astype(np.uint64) << np.uint64(8 * j)
        owners.append(owner[long])
        out.append(word)
    first = np.cumsum(length) - length
    power = np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = low[letter].astype(np.uint64) + np.uint64(1)
    value *= power[np.arange(len(value)) - np.repeat(first, length)]
    word = np.add.reduceat(value, first)
    word ^= word >> np.uint64(32)
    word *= np.uint64(0xD6E8FEB86659FD93)
    word ^= word >> np.uint64(29)
    owners.append(owner)
    out.append(word | np.uint64(1 << 63))
    wide = (raw & 0xF0) == 0xE0
    if wide.any():
        at = np.flatnonzero(wide[:-6] & wide[3:-3])
        pair = np.full(len(at), PAIR << 56, np.uint64)
        for j in range(6):
            pair |= raw[at + j].astype(np.uint64) << np.uint64(8 * j)
        owners.append(np.searchsorted(ends, at, side="right"))
        out.append(pair)
    return np.concatenate(owners), np.concatenate(out)


def counts(texts: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, term number, times)`` of the vocabulary's terms in the texts, ascending."""
    owner, term = terms(texts)
    at = np.searchsorted(vocabulary, term)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
    key, times = np.unique(owner[hit] * np.int64(max(1, len(vocabulary))) + at[hit], return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), times


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class Index:
    """Examples' unit vectors.  Rare terms have postings; the most frequent ones have a column, with its largest
    weight for each block of examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_terms: int, ids: np.ndarray | None = None):
        self.labels, self.n_docs, self.n_terms = labels, len(vectors), n_terms
        self.ids = np.arange(len(vectors)) if ids is None else ids
        self.term = np.concatenate([v[0] for v in vectors]).astype(np.int32) if vectors else np.empty(0, np.int32)
        self.weight = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
        self.at = np.concatenate(([0], np.cumsum([len(v[0]) for v in vectors]))).astype(np.int64)
        self.tables = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def ready(self):
        """``(column of each term or -1, bounds of the others' postings, examples, weights, columns, block maxima)``."""
        if self.tables is None:
            n = np.bincount(self.term, minlength=self.n_terms)
            common = np.argsort(-n, kind="stable")[:COLUMNS]
            column = np.full(self.n_terms, -1, np.int64)
            column[common] = np.arange(len(common))
            doc = np.repeat(np.arange(self.n_docs), np.diff(self.at))
            dense = np.zeros((-(-self.n_docs // BLOCK) * BLOCK, len(common)), np.float32)
            c = column[self.term]
            dense[doc[c >= 0], c[c >= 0]] = self.weight[c >= 0]
            top = dense.reshape(-1, BLOCK, len(common)).max(1)
            rare = np.flatnonzero(c < 0)
            rare = rare[np.argsort(self.term[rare], kind="stable")]
            bounds = np.searchsorted(self.term[rare], np.arange(self.n_terms + 1))
            self.tables = column, bounds, doc[rare], self.weight[rare], dense, top
        return self.tables

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a cosine above 0, exactly."""
        return self.nearest_of([(term, weight)], k, [but])[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of every query."""
        if not self.n_docs or not queries:
            return [(np.empty(0, np.int64), np.empty(0)) for _ in queries]
        column, bounds, doc, posted, dense, top = self.ready()
        nq, width = len(queries), len(dense)
        term, weight = np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries])
        owner = np.repeat(np.arange(nq), [len(q[0]) for q in queries])
        c = column[term]
        common = np.zeros((nq, dense.shape[1]), np.float32)
        common[owner[c >= 0], c[c >= 0]] = weight[c >= 0]
        n = bounds[term + 1] - bounds[term]
        first = np.searchsorted(owner, np.arange(nq + 1))
        before = np.concatenate(([0], np.cumsum(n)))[first]
        rare, q = np.empty((nq, width)), 0
        while q < nq:  # queries with about POSTINGS postings together
            till = max(q + 1, int(np.searchsorted(before, before[q] + POSTINGS, side="right")) - 1)
            part = slice(first[q], first[till])
            m, posting = n[part], spread(bounds[term[part]], n[part])
            place = np.repeat((owner[part] - q) * width, m) + doc[posting]
            rare[q:till] = np.bincount(place, np.repeat(weight[part], m) * posted[posting], (till - q) * width).reshape(-1, width)
            q = till
        for i, j in enumerate(but or []):
            if j >= 0:
                rare[i, j] = -1e9
        # the rare terms' share alone is the least that the nearest k reach; blocks whose bound is below it are skipped
        least = np.partition(rare, width - k, 1)[:, width - k] if width > k else np.zeros(nq)
        bound = rare.reshape(nq, -1, BLOCK).max(2) + common @ top.T
        scores = np.full((nq, width), -1e9, np.float32)
        for b in range(width // BLOCK):
            rows, block = np.flatnonzero(bound[:, b] >= least - SLACK), slice(b * BLOCK, (b + 1) * BLOCK)
            if len(rows):
                scores[rows, block] = rare[rows, block] + common[rows] @ dense[block].T
        kth = np.partition(scores, width - k, 1)[:, width - k] if width > k else np.full(nq, -1.0)
        # single precision has told the nearest k and those too close to tell; their cosines are computed anew
        row, near = np.nonzero((scores >= kth[:, None] - SLACK) & (scores > 0))
        ends = np.searchsorted(row, np.arange(nq + 1))
        query, out = np.zeros(self.n_terms), []
        for i, (t, w) in enumerate(queries):
            docs = near[ends[i] : ends[i + 1]]
            if not len(docs):
                out.append((docs, np.empty(0)))
                continue
            query[t] = w
            n = self.at[docs + 1] - self.at[docs]
            entry = spread(self.at[docs], n)
            cosines = np.add.reduceat(query[self.term[entry]] * self.weight[entry], np.cumsum(n) - n)
            query[t] = 0
            keep = np.lexsort((docs, -cosines))[:k]
            out.append((docs[keep], cosines[keep]))
        return out

    def vote(self, docs: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours; a near copy outvotes many that only share common words, and few votes count less."""
        w = (cosines / cosines.max()) ** SHARPNESS
        return float(((w * self.labels[docs]).sum() + DOUBT / 2) / (w.sum() + DOUBT))


def unit(term: np.ndarray, times: np.ndarray, idf: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit TF-IDF vector of all whole terms, to which that of the marks, ``MARKS`` times as long, is added."""
    w = (1 + np.log(times)) * idf[term]
    marked = mark[term]
    for part, size in ((~marked, 1.0), (marked, MARKS)):
        if part.any():
            w[part] *= size / np.sqrt((w[part] * w[part]).sum())
    return term, w / np.sqrt((w * w).sum())


class Model:
    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, mark: np.ndarray, index: Index, curve: tuple[float, float], without: float):
        self.vocabulary, self.idf, self.mark, self.index, self.curve, self.without = vocabulary, idf, mark, index, curve, without

    def score(self, texts: list[bytes], evidence: bool = False) -> tuple[list[float], list[list[int]]]:
        scores, near = [self.without] * len(texts), [[] for _ in texts]
        if len(self.vocabulary):
            owner, term, times = counts(texts, self.vocabulary)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            vectors = [unit(term[a:b], times[a:b], self.idf, self.mark) for a, b in zip(first, np.append(first[1:], len(owner)))]
            for i, (docs, cosines) in zip(owner[first], self.index.nearest_of(vectors)):
                if len(docs):
                    x = self.index.vote(docs, cosines)
                    scores[i] = 1 / (1 + np.exp(-(self.curve[0] * x + self.curve[1])))
                    near[i] = self.index.ids[docs].tolist()
        return scores, near


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's steps for p = 1 / (1 + exp(-(a x + b))), with targets drawn in a little; a stays positive."""
    a, b = 4.0, -2.0
    if not len(x):
        return a, b
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((p - t) * x).sum() + 1e-3 * (a - 4), (p - t).sum() + 1e-3 * (b + 2)])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return (a, b) if a > 0 else (4.0, -2.0)


def cover(examples: list[list[int]], labels: list[int], n_terms: int) -> list[int]:
    """Terms chosen one by one: each time the one in most toxic examples that have no chosen term yet, less a
    fine for its other examples; and those in a large share of them.  A term that only rides along with others in copies of an example isn't chosen."""
    has = [[] for _ in range(n_terms)]
    fine = np.zeros(n_terms)
    gain = np.zeros(n_terms)
    for i, (terms_, y) in enumerate(zip(examples, labels)):
        for t in terms_:
            if y:
                has[t].append(i)
                gain[t] += 1
            else:
                fine[t] += 1
    least, strong = max(3.0, LEAST_GAIN * sum(labels)), max(5.0, STRONG * sum(labels))
    done: set[int] = set()
    out = {int(t) for t in np.flatnonzero(gain - FINE * fine >= strong)}
    while n_terms:
        t = int(np.argmax(gain - FINE * fine))
        if gain[t] - FINE * fine[t] < least:
            break
        out.add(t)
        for i in has[t]:
            if i not in done:
                done.add(i)
                for u in examples[i]:
                    gain[u] -= 1
    return sorted(out)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of examples by term and label."""
    for batch in batches:
        for rows in text_slices(batch, 0, TOGETHER_BYTES):
            texts, toxic = rows.column(0).to_pylist(), np.asarray(rows.column(1).to_pylist(), np.int64)
            owner, term = terms(texts)
            pair = np.unique(np.stack([term, owner.astype(np.uint64)]), axis=1) if len(term) else np.empty((2, 0), np.uint64)
            y = toxic[pair[1].astype(np.int64)]
            t, inverse = np.unique(pair[0], return_inverse=True)
            bad = np.bincount(inverse, y, len(t)).astype(np.int64)
            good = np.bincount(inverse, 1 - y, len(t)).astype(np.int64)
            yield pa.record_batch([pa.array(t.view(np.int64)), pa.array(bad), pa.array(good)], names=["term", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Learn from the documents that ``labels`` (id and 0/1 label) names; count ``docs`` for the IDF.

    The labels are sampled first; the sample, at most about twice ``EXAMPLES_PER_LABEL`` ids, is broadcast to
    the documents, so texts aren't shuffled."""
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    given = given.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    u = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked_ids = given.where(u < F.when(F.col("toxic") == 1, F.lit(min(1.0, EXAMPLES_PER_LABEL / n[1]))).otherwise(F.lit(min(1.0, EXAMPLES_PER_LABEL / n[0])))).limit(3 * EXAMPLES_PER_LABEL)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text")
    rows = docs.select(F.col(id_col).alias("_id"), text).join(F.broadcast(picked_ids), "_id")
    sample = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.max_by("text", "toxic").alias("text"), F.min("_id").alias("id")).select("text", "toxic", F.col("id").cast("long"))
    sample = cut(sample)
    m = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = m.get(1, 0), m.get(0, 0)
    if not bad or not good:
        return None
    low = (F.col("bad") - F.sqrt(F.col("bad").cast("double"))) / F.lit(float(bad))
    high = (F.col("good") + F.sqrt(F.col("good").cast("double")) + 0.5) / F.lit(float(good))
    marks = (F.col("bad") >= max(2, bad // 250)) & (low >= RATIO * high)
    whole = (F.col("term") < 0) | (F.col("term") >= F.lit(PAIR << 56))
    seen = (
        sample.mapInArrow(tidy_batches(_count_terms), "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .select("term", whole.alias("whole"), marks.alias("marks"), (F.col("bad") + F.col("good")).alias("n")).where("whole or marks").toArrow()
    )
    vocabulary = seen["term"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary = vocabulary[order]
    whole, marks, often = (seen[c].to_numpy()[order] for c in ("whole", "marks", "n"))
    context = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 0, TOGETHER_BYTES):
                texts = rows.column(0).to_pylist()
                owner, term, times = counts(texts, context.value)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                parts = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.record_batch([rows.column(1), rows.column(2), *parts], names=["toxic", "id", "term", "times"])

    got = sample.mapInArrow(tidy_batches(vectors), "toxic int, id long, term array<int>, times array<int>").toArrow().combine_chunks()
    labels, ids = got["toxic"].to_numpy(), got["id"].to_numpy()
    lists = [(t.values.to_numpy(), n.values.to_numpy()) for t, n in zip(got["term"], got["times"])]
    candidates = np.flatnonzero(marks)
    number = np.cumsum(marks) - 1
    chosen = candidates[cover([number[t[marks[t]]].tolist() for t, _ in lists], labels.tolist(), len(candidates))]
    mark = np.zeros(len(vocabulary), bool)
    mark[chosen] = True
    # examples that share their most frequent terms get neighbouring numbers, so that blocks are alike
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, -often))] = np.arange(len(vocabulary))
    by = sorted(range(len(lists)), key=lambda i: (labels[i], np.sort(rank[lists[i][0]]).astype(">i4").tobytes(), ids[i]))
    keep = whole | mark
    place = np.cumsum(keep) - 1
    vocabulary, mark = vocabulary[keep], mark[keep]
    labels, ids, lists = labels[by], ids[by], [(place[t[keep[t]]], n[keep[t]]) for t, n in (lists[i] for i in by)]
    size = len(vocabulary)
    terms_shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for rows in text_slices(batch, 0, TOGETHER_BYTES):
                texts = [t or b"" for t in rows.column(0).to_pylist()]
                total[:size] += np.bincount(counts(texts, terms_shared.value)[1], minlength=size)[:size]
                total[size] += len(texts)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["t", "n"])

    df = np.zeros(size + 1)
    found = docs.select(F.col(text_col).cast("binary")).mapInArrow(tidy_batches(document_counts), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df[found["t"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((df[size] + 1) / (df[:size] + 0.5)) + 1
    with_terms = [i for i, (t, _) in enumerate(lists) if len(t)]
    units = [unit(*lists[i], idf, mark) for i in with_terms]
    index = Index(units, labels[with_terms], size, ids[with_terms])
    x, y = [], []
    for at in range(0, len(units), 50):
        part = range(at, min(at + 50, len(units)))
        for j, near in zip(part, index.nearest_of([units[j] for j in part], but=list(part))):
            if len(near[0]):
                x.append(index.vote(*near))
                y.append(index.labels[j])
            x.append(index.vote(np.append(j, near[0][: NEIGHBOURS - 1]), np.append(1.0, near[1][: NEIGHBOURS - 1])))
            y.append(index.labels[j])
    none = [labels[i] for i, (t, _) in enumerate(lists) if not len(t)]
    without = min(0.49, (sum(none) + 0.5) / (len(none) + 2))
    context.destroy()
    terms_shared.destroy()
    index.tables = None
    del seen, got, lists, units, df, found
    release()
    return Model(vocabulary, idf, mark, index, logistic(np.array(x), np.array(y)), without)


def score(docs: DataFrame, model: Model | None, *more: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, <more>, score, predicted, evidence)`` of every row; evidence: ids of the nearest examples, nearest
    first (an example whose text several labelled rows have goes by the least id).  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows in text_slices(batch, 0, TOGETHER_BYTES, TOGETHER):
                texts = [t or b"" for t in rows.column(0).to_pylist()]
                s, near = m.score(texts) if m else ([0.0] * len(texts), [[] for _ in texts])
                predicted = pa.array([int(x >= 0.5) for x in s], pa.int32())
                yield pa.record_batch([*rows.columns[1:], pa.array(s, pa.float64()), predicted, pa.array(near, pa.list_(pa.int64()))], names=[*rows.schema.names[1:], "score", "predicted", "evidence"])

    source = docs.select(F.col(text_col).cast("binary").alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *more)
    fields = ", ".join(f"{n} {t}" for n, t in source.dtypes[1:])
    return source.mapInArrow(tidy_batches(work), f"{fields}, score double, predicted int, evidence array<long>")
