"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of 256; each window goes through filters of several widths
over one-hot bytes, max pooling over the window, a rectifier and a softmax layer.  A text's
probabilities are the mean of its windows', weighted by their letters and other bytes that aren't
padding.  The network is trained in numpy, on the driver, on a bounded sample of labelled windows.

Inference adds up table rows: a filter of width w over one-hot bytes is a sum of w table rows, and
the tables of two neighbouring bytes are joined into one of 65,536 rows beforehand.

Defined results: null text, or text without any letter, is ``und`` with score 0; rows whose label is
null take no part in training; without any labelled row every text is ``und``; every row gives a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sortkit.llm.common import text_slices, tidy_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bounds of the training sample: documents of a language, all documents, windows of a document.
DOCS_PER_LANGUAGE = 500
DOCS_IN_ALL = 8_000
WINDOWS_PER_DOC = 6
STEPS = 1_200
BATCH = 96
UNKNOWN = "und"


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, the last padded with zeros."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on cross entropy; pooling sends a filter's gradient to its best position only."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        by_class = [np.flatnonzero(y == c) for c in range(len(self.classes))]
        f = np.arange(FILTERS)
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(i, max(1, BATCH // len(by_class))) for i in by_class])
            bx, by = x[pick].astype(np.int64), y[pick]
            pooled, best = [], []
            for t, w in zip(self.tables, WIDTHS):
                act = t[0][bx[:, : WINDOW - w + 1]]
                for k in range(1, w):
                    act = act + t[k][bx[:, k : WINDOW - w + 1 + k]]
                at = act.argmax(1)
                best.append(at)
                pooled.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + self.bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ self.out + self.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p
            d[np.arange(len(by)), by] -= 1
            d /= len(by)
            d_hidden = (d @ self.out.T) * (raw > 0)
            grads = []
            for j, w in enumerate(WIDTHS):
                g = np.zeros_like(self.tables[j])
                part = d_hidden[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(bx, best[j] + k, 1), f[None, :]), part)
                grads.append(g)
            grads += [d_hidden.sum(0), hidden.T @ d + 1e-4 * self.out, d.sum(0)]
            rate = 0.02 * (1 - 0.9 * step / steps)
            for p_, g, m_, v_ in zip(params, grads, m, v):
                m_ *= 0.9
                m_ += 0.1 * g
                v_ *= 0.99
                v_ += 0.01 * g * g
                p_ -= rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.99**step)) + 1e-8)

    def ready(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The trained network with joined tables."""

    def __init__(self, net: Network):
        self.classes, self.bias, self.out, self.out_bias = net.classes, net.bias, net.out, net.out_bias
        join = lambda a, b: (a[None, :, :] + b[:, None, :]).reshape(65536, FILTERS)  # noqa: E731  index: first byte + 256 * second
        two, three, four = net.tables
        self.two, self.three, self.three_last = join(two[0], two[1]), join(three[0], three[1]), three[2].copy()
        self.four, self.four_last = join(four[0], four[1]), join(four[2], four[3])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of every window; a few hundred at a time to stay in the cache."""
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), 256):
            b = x[at : at + 256].T  # position first, so that pooling takes maxima of whole rows
            pair = b[:-1].astype(np.uint16)
            pair |= b[1:].astype(np.uint16) << np.uint16(8)
            best2 = self.two.take(pair, 0).max(0)
            act = self.three.take(pair[:-1], 0)
            act += self.three_last.take(b[2:], 0)
            best3 = act.max(0)
            act = self.four.take(pair[:-2], 0)
            act += self.four_last.take(pair[2:], 0)
            hidden = np.maximum(np.concatenate((best2, best3, act.max(0)), 1) + self.bias, 0)
            logits = hidden @ self.out + self.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + 256] = p / p.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parts, weights, owner = [], [], []
        for i, t in enumerate(texts):
            if t and has_letter(t):
                raw = t.encode("utf-8", "replace")
                w = windows(raw)
                parts.append(w)
                size = np.full(len(w), WINDOW, np.float64)
                size[-1] = len(raw) - WINDOW * (len(w) - 1)
                weights.append(size)
                owner.append(np.full(len(w), i))
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if parts:
            p = self.probabilities(np.concatenate(parts)) * np.concatenate(weights)[:, None]
            own = np.concatenate(owner)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            total = np.add.reduceat(p, first, 0)
            total /= total.sum(1, keepdims=True)
            for i, row in zip(own[first].tolist(), total):
                k = int(row.argmax())
                lang[i], score[i] = self.classes[k], min(1.0, max(0.0, float(row[k])))
        return lang, score


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(t: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(t))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on a sample within the bounds above: of each language the distinct texts with the least hashes.  Every
    labelled language is a class; with more languages than ``DOCS_IN_ALL``, each has one document."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.where("text <> ''").withColumn("h", F.xxhash64("text"))
    hashes = rows.select("lang", "h").distinct()
    n_languages = hashes.select("lang").distinct().count()
    if not n_languages:
        return None
    each = max(1, min(DOCS_PER_LANGUAGE, DOCS_IN_ALL // n_languages))
    picked = hashes.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= each).select("lang", "h")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, out = [], []
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = windows(t.encode("utf-8", "replace"))
                for i in sorted({int(j) for j in np.linspace(0, len(w) - 1, WINDOWS_PER_DOC)}) if len(w) else []:
                    lang.append(k)
                    out.append(w[i].tobytes())
            yield pa.record_batch([pa.array(lang, pa.string()), pa.array(out, pa.binary())], names=["lang", "w"])

    chosen = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")
    got = chosen.mapInArrow(cut_windows, "lang string, w binary").orderBy("lang", F.xxhash64("w"), "w").toArrow()
    classes = sorted(set(got["lang"].to_pylist()))
    if not classes:
        return None
    x = np.frombuffer(b"".join(got["w"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    index = {c: i for i, c in enumerate(classes)}
    y = np.array([index[c] for c in got["lang"].to_pylist()])
    net = Network(classes)
    net.train(x, y)
    return net


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``(doc_id, <more>, lang_pred, score)`` of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.ready() if shared.value else None
        for batch in batches:
            for rows in text_slices(batch, 0, 400_000):
                texts = rows.column(0).to_pylist()
                lang, score = scorer.predict(texts) if scorer else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.record_batch([*rows.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*rows.schema.names[1:], "lang_pred", "score"])

    source = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *more)
    fields = ", ".join(f"{n} {t}" for n, t in source.dtypes[1:])
    return source.mapInArrow(tidy_batches(work), f"{fields}, lang_pred string, score double")
