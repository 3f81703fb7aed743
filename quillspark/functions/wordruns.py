"""Runs of words as rolling hashes, over Arrow batches of texts, for all lengths in one pass.

Words are runs of ``[a-z0-9]`` of texts that are lower-cased already. The hash of a run of n + 1
words follows from that of its first n and the next word's, so lengths cost one multiplication
and addition a word each. Hashes only sort out: what matters is compared by sha256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_STEP, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some texts: their bytes, hashes, and the text each is in."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        inside = np.concatenate([[False], _WORD[buf], [False]])
        # a word ends with its text
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.buf = buf
        self.text = np.searchsorted(off, self.start, side="right") - 1

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        power = np.multiply.accumulate(np.full(int(size.max()), _STEP))
        byte = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        value = (self.buf[np.repeat(self.start, size) + byte].astype(np.uint64) + np.uint64(1)) * power[byte]
        return _mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))

    def runs(self, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first words, hashes) of the runs of each length that lie within one text."""
        h = self.hashes()
        roll = np.zeros(len(h), np.uint64)
        for n in range(1, max(lengths, default=0) + 1):
            left = len(h) - n + 1
            if left <= 0:
                return
            roll = roll[:left] * _ROLL + h[n - 1 :]
            if n in lengths:
                first = np.flatnonzero(self.text[:left] == self.text[n - 1 :])
                yield n, first, _mixed(roll[first] ^ np.uint64(n))

    def sha256(self, first: int, n: int) -> str:
        """Of the run's words, joined by blanks."""
        spans = zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True)
        return hashlib.sha256(b" ".join(self.buf[a:b].tobytes() for a, b in spans)).hexdigest()


def words_of(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """The words of about ``CHUNK_BYTES`` of whole texts at a time, after the place of the first."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


class BitTable:
    """A Bloom filter over 64-bit hashes: four bits of each, ``bits`` (a power of two) in all."""

    PROBES = 4

    def __init__(self, bits: int, slots: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64)
        if slots is not None:
            self.words[slots] = values

    @staticmethod
    def place(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
        return (h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be in it; of those held, all."""
        left = np.arange(len(h))
        for k in range(self.PROBES):
            if not len(left):
                break
            place = self.place(h[left], k, self.bits)
            left = left[(self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return left
