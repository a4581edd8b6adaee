"""Vectorised word hashing and compact integer payloads.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``.  A word's hash is a polynomial of its
bytes modulo 2**64, mixed; an n-gram's hash is a polynomial of its words' hashes, mixed.  Two
different word sequences share a hash with probability of about 2**-60.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

U64 = np.uint64
_BASE_BYTE = 0x9E3779B97F4A7C17  # odd
_BASE_WORD = 0xC2B2AE3D27D4EB53  # odd
#: Bytes hashed in one go, unless one text is longer.
BLOCK = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12)
        inverse = pow(base, -1, 1 << 64)
        up = np.full(size, base, dtype=U64)
        down = np.full(size, inverse, dtype=U64)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _hash_block(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a buffer that begins and ends with a space."""
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    values = (_LOWER[buf] if lower else buf).astype(U64) + U64(1)
    up, down = powers(_BASE_BYTE, len(buf))
    values *= up
    total = np.cumsum(values, dtype=U64)
    h = (total[end - 1] - total[start - 1]) * down[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), start


def _hash_word(raw: np.ndarray, lower: bool) -> np.ndarray:
    """The hash of one word of any length, added up a block at a time."""
    total, shift = U64(0), 1
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        up, _ = powers(_BASE_BYTE, len(part))
        value = int((((_LOWER[part] if lower else part).astype(U64) + U64(1)) * up).sum(dtype=U64))
        total = U64((int(total) + value * shift) & 0xFFFFFFFFFFFFFFFF)
        shift = shift * pow(_BASE_BYTE, len(part), 1 << 64) & 0xFFFFFFFFFFFFFFFF
    length = U64(len(raw) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return mix(np.array([total], U64) + length)


def _hash_long(text: bytes, lower: bool) -> np.ndarray:
    """Word hashes of a text longer than a block, cut between words; memory is bounded by a block's arrays."""
    raw, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(raw):
        till = min(len(raw), at + BLOCK)
        if till < len(raw):
            spaces = np.flatnonzero(_SPACE[raw[at:till]])
            if not len(spaces):  # one word fills the block: find its end
                while till < len(raw) and not _SPACE[raw[till]]:
                    ahead = np.flatnonzero(_SPACE[raw[till : till + BLOCK]])
                    till = till + int(ahead[0]) if len(ahead) else min(len(raw), till + BLOCK)
                out.append(_hash_word(raw[at:till], lower))
                at = till
                continue
            till = at + int(spaces[-1]) + 1
        out.append(_hash_block(np.frombuffer(b" " + text[at:till] + b" ", np.uint8), lower)[0])
        at = till
    return np.concatenate(out) if out else np.empty(0, U64)


def hash_texts(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, concatenated, and offsets of length ``len(texts) + 1``."""
    hashes, counts = [], np.zeros(len(texts) + 1, dtype=np.int64)
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK:
            hashes.append(_hash_long(texts[at], lower))
            counts[at + 1] = len(hashes[-1])
            at += 1
            continue
        size, till = 0, at
        while till < len(texts) and (till == at or size + len(texts[till]) < BLOCK):
            size += len(texts[till]) + 1
            till += 1
        group = texts[at:till]
        buf = np.frombuffer(b" " + b" ".join(group) + b" ", dtype=np.uint8)
        h, start = _hash_block(buf, lower)
        hashes.append(h)
        lengths = np.fromiter((len(t) + 1 for t in group), dtype=np.int64, count=len(group))
        bounds = np.searchsorted(start, np.cumsum(lengths) + 1)
        counts[at + 1 : till + 1] = np.diff(np.concatenate(([0], bounds)))
        at = till
    return (np.concatenate(hashes) if hashes else np.empty(0, U64)), np.cumsum(counts)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries (also across text boundaries)."""
    n = len(h)
    if n < k:
        return np.empty(0, U64)
    out = np.empty(n - k + 1, U64)
    for at in range(0, n - k + 1, BLOCK):
        part = h[at : at + BLOCK + k - 1]
        up, down = powers(_BASE_WORD, len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[:-1], out=total[1:])
        m = len(part) - k + 1
        out[at : at + m] = mix((total[k:] - total[:-k]) * down[:m] + U64(k))
    return out


def inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the windows of k words that lie in one text."""
    n = int(offsets[-1])
    if n < k:
        return np.empty(0, np.int64)
    ok = np.ones(n, dtype=bool)
    for back in range(1, k):
        ends = offsets[1:] - back
        ok[ends[ends >= offsets[:-1]]] = False
    return np.flatnonzero(ok)


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, without the planes that are all zero."""
    a = np.ascontiguousarray(a, dtype=U64)
    if not len(a):
        return b""
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, U64)
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(U64).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending integers as differences."""
    a = np.asarray(a, U64)
    return pack(np.diff(a, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=U64)


def starts_of_runs(a: np.ndarray) -> np.ndarray:
    """Index of the first entry of each run of equal values."""
    if not len(a):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def rolling_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What ``rolling(h, 2)`` gives for neighbours a and b."""
    return mix(a + b * U64(_BASE_WORD) + U64(2))


def join_parts(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def squeeze(parts: list[bytes]) -> bytes:
    """Joined parts with their small numbers entropy-coded."""
    return zstandard.ZstdCompressor(level=1).compress(join_parts(parts))


def expand(b: bytes) -> list[bytes]:
    return [bytes(x) for x in split_parts(zstandard.ZstdDecompressor().decompress(b))]


def split_parts(b: bytes | memoryview) -> list[memoryview]:
    n = struct.unpack_from("<q", b)[0]
    sizes = struct.unpack_from(f"<{n}q", b, 8)
    out, at, view = [], 8 * (n + 1), memoryview(b)
    for s in sizes:
        out.append(view[at : at + s])
        at += s
    return out
