"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def cover(docs: list[tuple[int, str | None]], depth: int = 13) -> dict[int, tuple[int, int, str, str]]:
    """doc_id -> (n_words, n_removed, sha256, kept)."""
    first: dict[tuple, int] = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - depth + 1):
            key = tuple(w[k : k + depth])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - depth + 1):
            if first[tuple(w[k : k + depth])] < i:
                gone.update(range(k, k + depth))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


class Parts:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def jaccard(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id)."""
    sets = [(i, shingles(t)) for i, t in docs]
    lists = defaultdict(list)
    parts = Parts()
    for n, (_, s) in enumerate(sets):
        for g in s:
            lists[g].append(n)
    for n, (i, s) in enumerate(sets):
        parts.find(i)
        for m, both in Counter(m for g in s for m in lists[g] if m < n).items():
            if 100 * both >= 80 * (len(s) + len(sets[m][1]) - both):
                parts.join(i, sets[m][0])
    return {i: (len(s), parts.find(i)) for i, s in sets}


def lm(docs: list[tuple[int, str | None]], train: set[int], m2: float, m3: float) -> dict[int, tuple[int, int, int, float, float]]:
    """doc_id -> (n_tokens, n_known, N, base, score)."""
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    c: Counter = Counter()
    for i in train:
        w = tokens[i]
        for k in (1, 2, 3):
            c.update(zip(*[w[j:] for j in range(k)]))
    n, v = sum(len(tokens[i]) for i in train), sum(len(k) == 1 for k in c)
    out = {}
    for i, w in tokens.items():
        base = score = 0.0
        for j, x in enumerate(w):
            p = (c[(x,)] + 1) / (n + v + 1)
            base += math.log10(p)
            if j >= 1:
                p = (c[(w[j - 1], x)] + m2 * p) / (c[(w[j - 1],)] + m2)
            if j >= 2:
                p = (c[(w[j - 2], w[j - 1], x)] + m3 * p) / (c[(w[j - 2], w[j - 1])] + m3)
            score += math.log10(p)
        out[i] = (len(w), sum(c[(x,)] > 0 for x in w), n, base, score)
    return out


def usable(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def embedding_links(rows: list[tuple[int, list]], threshold: float = 0.9) -> tuple[list[int], dict[int, int]]:
    """Links of each row, and the component of each id."""
    parts, links = Parts(), [0] * len(rows)
    for a, (i, x) in enumerate(rows):
        parts.find(i)
        for b in range(a):
            j, y = rows[b]
            if usable(x) and usable(y) and len(x) == len(y):
                p, q = np.array(x, float), np.array(y, float)
                if p @ q / math.sqrt((p @ p) * (q @ q)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parts.join(i, j)
    return links, {i: parts.find(i) for i, _ in rows}


def kept(cells: dict[tuple, float], fitted: dict[tuple, float], keep: float) -> dict[tuple, float]:
    """Probabilities min(1, s * ratio), with s by halving so that the share ``keep`` of all tokens stays."""
    ratio = {k: fitted[k] / x if x else 1.0 for k, x in cells.items()}
    low, high = 0.0, 1e12
    for _ in range(300):
        s = (low + high) / 2
        if sum(x * min(1.0, s * ratio[k]) for k, x in cells.items()) < keep * sum(cells.values()):
            low = s
        else:
            high = s
    return {k: min(1.0, high * r) for k, r in ratio.items()}


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = 200) -> dict[tuple, float]:
    total = sum(cells.values())
    w = dict(cells)
    for _ in range(rounds):
        for m, t in enumerate(targets):
            have: dict = defaultdict(float)
            for k, x in w.items():
                have[k[m]] += x
            w = {k: x * t[k[m]] * total / have[k[m]] if have[k[m]] > 0 else x for k, x in w.items()}
    return w
