"""Very long texts and long batches: the same hashes in bounded memory, and whole results."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from sortkit.llm import arrays as A
from sortkit.llm import jaccard, substrings
from sortkit.llm.common import text_slices
from tests.llm import brute


def test_long_texts_hash_as_short_ones(monkeypatch):
    r = random.Random(5)
    words = [bytes(r.choices(range(33, 123), k=r.choice((1, 3, 8, 40, 700)))) for _ in range(300)]
    gaps = (b" ", b"\n", b" \t ", b"\r\n")
    texts = [b"".join(w + r.choice(gaps) for w in r.choices(words, k=n)) for n in (1, 5, 60, 200)] + [b"", b"  ", b"x" * 900, b" " * 900, words[4] * 9]
    want = [A.hash_texts([t], low)[0].tolist() for t in texts for low in (False, True)]
    monkeypatch.setattr(A, "BLOCK", 64)
    got = [A.hash_texts([t], low)[0].tolist() for t in texts for low in (False, True)]
    assert got == want and all(len(g) == len(t.split()) for t, g in zip(texts, got[::2]))
    together, at = A.hash_texts(texts)
    assert together.tolist() == [h for g in want[::2] for h in g] and at[-1] == len(together)


def test_a_text_of_50_mb_takes_bounded_memory():
    text = b"word of a very long text " * 2_000_000
    A.hash_texts([text[:3_000_000]])
    tracemalloc.start()
    h, _ = A.hash_texts([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == 12_000_000 and peak < 2.5 * h.nbytes + 60_000_000


def test_slices_are_bounded_by_bytes():
    texts = ["a" * n for n in (10, 2_000, 5, 900_000, 1, 1, 1)] * 20 + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts).cast(pa.binary())], names=["i", "t"])
    slices = list(text_slices(batch, 1, 1_000_000))
    assert [i for s in slices for i in s.column(0).to_pylist()] == list(range(len(texts)))
    assert all(s.num_rows == 1 or sum(len(t or b"") for t in s.column(1).to_pylist()) <= 1_000_000 for s in slices) and len(slices) < 45


def test_operators_on_a_long_text(spark):
    r = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(5_000)])
    long_text = " ".join(words[r.integers(0, 5_000, 600_000)])
    docs = [(1, long_text), (2, long_text + " end"), (3, " ".join(words[:40])), (4, None), (5, "x" * 3_000_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.cover(docs)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.cover(frame).collect()} == {i: w[:3] for i, w in want.items()}
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
