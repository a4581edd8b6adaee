"""Byte-level BPE: linear-time encoding by backtracking, decoding by an offset table.

A text is cut into pieces by the vocabulary's pattern.  In a piece, an Aho-Corasick automaton over
all tokens gives the longest token at every position.  The encoder goes from left to right with the
longest token, accepts it if it and the token before it form a compatible pair (merging their bytes
gives just these two tokens), and otherwise falls back to the next shorter token that is its prefix
or, without one, takes back the token before.  The result equals that of applying merges by rank.

Decoding gathers bytes from one array of all tokens' bytes by an array of offsets.

Defined results: null or empty text gives no ids and the empty text; ids outside the vocabulary
raise; a special token's string in a text becomes its id, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortkit.llm.arrays import ragged
from sortkit.llm.common import text_slices, tidy_batches

#: Fixed value: the pattern of byte-level BPE vocabularies of this family.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBER = 700_000
NONE = -1


def byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pairs(dict):
    """The pair-compatibility table, filled as pairs are met; the key is ``a << 16 | b``."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, key: int) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[key] = ok = self.tokenizer.compatible(key >> 16, key & 65535)
        return ok


class Tokenizer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        names = byte_names()
        vocab: dict[str, int] = d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for name, i in vocab.items():
            self.bytes[i] = name.encode() if name in self.special else bytes(names[c] for c in name)
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self.decimal = [str(i) for i in range(size)]
        lengths = np.fromiter(map(len, self.bytes), np.int64, size)
        self.lengths, self.offsets = lengths, np.concatenate(([0], np.cumsum(lengths)))
        self.buffer = np.frombuffer(b"".join(self.bytes), np.uint8)
        # rank and parts of every merged token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(d["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (vocab[a], vocab[b])
            self.rank[pair], self.made[pair] = r, vocab[a + b]
            self.parts.setdefault(vocab[a + b], pair)
        self.born = {i: self.rank[p] for i, p in self.parts.items()}
        # only tokens that merges reach can be results
        # (as length less one and id in one number)
        if size > 65536:
            raise ValueError("vocabularies over 65,536 tokens aren't supported")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        by_bytes: dict[bytes, int] = {}
        for name, i in vocab.items():
            if name not in self.special and (i in self.parts or len(self.bytes[i]) == 1):
                by_bytes[self.bytes[i]] = v = (len(self.bytes[i]) - 1) << 16 | i
                self.automaton.add_word(self.bytes[i].decode("latin-1"), v)
        self.automaton.make_automaton()
        #: The longest token that is a proper prefix; NONE if there is none.
        self.shorter: dict[int, int] = {}
        for b, v in by_bytes.items():
            self.shorter[v] = next((by_bytes[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in by_bytes), NONE)
        self.pairs = _Pairs(self)
        self.split = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives just a and b: no merge crosses their border
        before the two are whole.  Along the border only the last part of a and the first part of b
        at each moment can merge, so it is enough to undo the younger of the two step by step."""
        # Twice the rank before which a merge over the border comes first; among equal ranks the
        # leftmost merge comes first, which is the left side's own or else the one over the border.
        limit, ok = 2 * len(self.rank) + 2, True
        while True:
            r = self.rank.get((a, b))
            if r is not None and 2 * r < limit:
                ok = False
                break
            ra, rb = self.born.get(a, -1), self.born.get(b, -1)
            if ra > rb:
                limit, a = 2 * ra, self.parts[a][1]
            elif rb >= 0:
                limit, b = 2 * rb + 1, self.parts[b][0]
            else:
                break
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [0] * n
        for end, v in self.automaton.iter(piece.decode("latin-1")):
            longest[end - (v >> 16)] = v  # ends ascend, so a later match of a start is longer
        shorter, pairs = self.shorter, self.pairs
        out: list[int] = []
        at, before, v, dead = 0, -1, longest[0], 0
        while True:
            end = at + (v >> 16) + 1
            if not dead >> end & 1 and (before < 0 or pairs[before << 16 | v & 65535]):
                out.append(v)
                if end == n:
                    return [v & 65535 for v in out]
                at, before, v = end, v & 65535, longest[end]
                continue
            v = shorter[v]
            while v == NONE:  # no token fits here after the one before: that one is wrong
                dead |= 1 << at
                v = out.pop()
                at -= (v >> 16) + 1
                v = shorter[v]
                before = out[-1] & 65535 if out else -1

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out: list[int] = []
        for piece in self.split(text):
            out += self.encode_piece(piece.encode())
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut(text) if self.cut else [text]:
            out += [self.special[part]] if part in self.special else self.encode_part(part)
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.buffer[ragged(self.offsets[ids], self.lengths[ids])].tobytes()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class _Memory(dict):
    """Unit (what stands after a space) -> its number among the units seen since the last start."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.ids = array("H")
        self.ends = array("i", [0])

    def __missing__(self, unit: str) -> int:
        # a word, or a word and a mark, is one piece, or two, by the pattern
        if unit.isalpha():
            self.ids.extend(self.tokenizer.encode_piece((" " + unit).encode()))
        elif unit[-1:] in MARKS and unit[:-1].isalpha():
            n = self[unit[:-1]]
            self.ids.extend(self.ids[self.ends[n] : self.ends[n + 1]])
            self.ids.extend(self.tokenizer.encode_piece(unit[-1:].encode()))
        else:
            self.ids.extend(self.tokenizer.encode_part(" " + unit))
        self.ends.append(len(self.ids))
        self[unit] = n = len(self.ends) - 2
        return n


#: Marks that end a piece and don't begin a contraction.
MARKS = {".", ",", ";", ":", "!", "?", "|"}
#: White space at an end of a text or more than one in a row.
_RUN = re.compile(r"\s\s|^\s|\s\Z").search
_CUT = re.compile(r"(?<=\S) (?=\S)").split


class TextCoder:
    """Encodes whole texts, remembering pieces."""

    def __init__(self, tokenizer: Tokenizer):
        self.t = tokenizer
        self.memory = _Memory(tokenizer)

    def ids(self, text: str) -> np.ndarray:
        out, t = [], self.t
        for part in t.cut(text) if t.cut else [text]:
            if part in t.special:
                out.append(np.array([t.special[part]], np.int64))
            elif part:
                if len(self.memory) > REMEMBER:
                    self.memory = _Memory(t)
                # No piece crosses the front of a single space between two other characters.
                units = _CUT(part) if _RUN(part) else part.split(" ")
                out.append(np.array(t.encode_part(units[0]), np.int64))
                del units[0]
                numbers = np.fromiter(map(self.memory.__getitem__, units), np.int64, len(units))
                ends = np.frombuffer(self.memory.ends, np.int32)
                first = ends[numbers].astype(np.int64)
                picked = np.frombuffer(self.memory.ids, np.uint16)[ragged(first, ends[numbers + 1] - first)]
                del ends  # an array that is looked at can't grow
                out.append(picked.astype(np.int64))
        return np.concatenate(out) if out else np.empty(0, np.int64)


_loaded: dict[str, TextCoder] = {}


def coder(spec: str) -> TextCoder:
    """The coder of a vocabulary; a worker builds it once."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TextCoder(Tokenizer(spec))
    return _loaded[key]


def load_spec(path: str) -> str:
    """A vocabulary file's text; read on the driver and sent to the executors (2 MB at most)."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64_000_000:
        raise ValueError("vocabulary files over 64 MB are not broadcast")
    return spec


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row; no shuffle."""
    return _run(docs, vocabulary, id_col, text_col, keep_ids=True).select("doc_id", "ids")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])`` of every row after encoding and decoding."""
    return _run(docs, vocabulary, id_col, text_col, keep_ids=with_ids)


def _run(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load_spec(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value)
        t = c.t
        for batch in batches:
            for rows in text_slices(batch, 1, 500_000):
                out_ids, n, sha_ids, sha_text = [], [], [], []
                for text in rows.column(1).to_pylist():
                    ids = c.ids(text or "")
                    if keep_ids:
                        out_ids.append(ids.astype(np.int32))
                    n.append(len(ids))
                    sha_ids.append(hashlib.sha256(",".join(map(t.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    sha_text.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
                more = [pa.array(out_ids, pa.list_(pa.int32()))] * keep_ids
                yield pa.record_batch([rows.column(0), pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy_batches(work), schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of encoded rows; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_spec(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = coder(shared.value).t
        for batch in batches:
            texts = [t.decode(np.asarray(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(work, "doc_id long, text string")
