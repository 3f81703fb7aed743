"""Vectorised word, shingle and line arithmetic over Arrow text columns.

Everything here runs inside Spark tasks on one Arrow batch at a time. A batch is cut
into chunks of whole documents of about ``CHUNK_BYTES`` so that the temporary numpy
arrays stay small whatever the batch holds; one document longer than that is a chunk of
its own. A null text counts as the empty text.

Hashes are 64-bit polynomial hashes finished by a bit mixer. They depend on bytes alone,
so every executor and every run gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xC2B2AE3D27D4EB4F)
_pow = np.ones(1, np.uint64)

_b = np.arange(256)
#: [^\x20\x09-\x0D]
NOT_SPACE = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)
LOWER = np.where((_b >= 0x41) & (_b <= 0x5A), _b + 32, _b).astype(np.uint8)


def _powers(n: int) -> np.ndarray:
    global _pow
    if n > len(_pow):
        _pow = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 64) * 2, _POW_BASE)]))
    return _pow


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Some whole documents: ``buf`` their bytes, ``off`` len+1 byte offsets into it."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into chunks of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(arr)
    if not n:
        return
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Chunk(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


@dataclass
class Words:
    """Words of a chunk: byte spans, the first word of each document, the document of each word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    wo: np.ndarray
    doc: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n, first = self.end - self.start, int(self.start[0])
        size = np.diff(np.append(self.start, len(self.buf)))
        pos = np.arange(len(self.buf) - first) - np.repeat(self.start - first, size)
        inside = pos < np.repeat(n, size)
        val = _BYTE[self.buf[first:]]
        val *= _powers(int(n.max()) + 1)[np.where(inside, pos, 0)]
        val[~inside] = 0
        return mix64(np.add.reduceat(val, self.start - first) + n.astype(np.uint64))


def words(chunk: Chunk, is_word: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Runs of bytes for which ``is_word`` holds; a run ends with its document."""
    buf, off = (LOWER[chunk.buf] if lower else chunk.buf), chunk.off
    m = is_word[buf]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    edge = off[(off > 0) & (off < len(buf))]
    s[edge] = m[edge]
    e[edge - 1] = m[edge - 1]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    wo = np.searchsorted(start, off)
    return Words(buf, start, end, wo, np.repeat(np.arange(len(off) - 1), np.diff(wo)))


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and whether each lies within one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _ROLL
        out += h[j : j + n]
    return mix64(out ^ np.uint64(k)), doc[:n] == doc[k - 1 : k - 1 + n]


def shingle_sets(chunk: Chunk, k: int, is_word: np.ndarray = NOT_SPACE, lower: bool = True) -> list[np.ndarray]:
    """Each document's distinct k-word shingles as sorted hashes; the whole sequence is one
    shingle where there are fewer words, and no words give the empty set."""
    w = words(chunk, is_word, lower)
    h = w.hashes()
    g, ok = windows(h, w.doc, k)
    out = []
    for a, b in zip(w.wo[:-1].tolist(), w.wo[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(windows(h[a:b], w.doc[a:b], b - a)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one array for each row."""
    off = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def structs(**cols) -> pa.Array:
    """A struct column; its fields are sorted as given."""
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], list(cols))
