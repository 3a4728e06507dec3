"""Words, word windows and their 64-bit hashes, computed over whole Arrow batches of text.

A word is a run of bytes other than space and U+0009 to U+000D. Null text is empty text.
Everything works on the UTF-8 buffer, so no Python object is made per word. Hashes are polynomials modulo 2^64, for which
unequal words of the same hash are known from 1,024 bytes on; words of ``LONG_WORD`` bytes and more take a digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document forms a piece of its own.
PIECE_BYTES = 1 << 19
#: Bytes from which a word's hash is a digest of its bytes.
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(count: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of a run of documents.

    ``start`` and ``end`` are byte positions in ``data``; ``first[d]:first[d + 1]`` are the words of
    document ``d``; ``offsets`` are the documents' byte positions.
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    total: np.ndarray
    inverse: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of any byte ranges."""
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first) of all windows of ``k`` words; documents with fewer words have none."""
        n = len(self.hash)
        counts = np.maximum(np.diff(self.first) - (k - 1), 0)
        first = np.concatenate(([0], np.cumsum(counts)))
        if n < k or not first[-1]:
            return np.empty(0, np.uint64), first
        factor = numbers(k, seed) | np.uint64(1)
        total = self.hash[: n - k + 1] * factor[0]
        for j in range(1, k):
            total += self.hash[j : n - k + 1 + j] * factor[j]
        at = np.repeat(self.first[:-1] - first[:-1], counts) + np.arange(first[-1])
        return mix(total[at]), first

    def text(self, word: int) -> str:
        return self.data[self.start[word] : self.end[word]].tobytes().decode("utf-8", "replace")


def _tables(lower: bool, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    value = numbers(256, 7)
    if lower:
        value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    if letters:  # words are runs of letters, digits and all characters beyond ASCII
        space[:128] = True
        space[48:58] = space[65:91] = space[97:123] = False
    return value, space


class Splitter:
    """Cuts pieces of text into hashed words; keeps the power tables between pieces."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, lower: bool = False, letters: bool = False):
        self.value, self.space = _tables(lower, letters)
        self.lower = lower
        self.power = self.inverse = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("power", self.BASE), ("inverse", inverse)):
                table = np.full(n, np.uint64(base))
                table[0] = 1
                setattr(self, name, np.cumprod(table))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        n = len(data)
        gap = self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n + 1, bool)  # position i follows a gap or a document's start
        before[0] = True
        before[1:] = gap
        before |= edge
        start = np.flatnonzero(before[:-1] & ~gap)
        after = np.empty(n + 1, bool)
        after[-1] = True
        after[:-1] = gap
        after |= edge
        end = np.flatnonzero(after[1:] & ~gap) + 1
        self._powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.value[data] * self.power[:n], out=total[1:])
        hashed = (total[end] - total[start]) * self.inverse[start]
        hashed = mix(hashed + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
            word = data[start[i] : end[i]].tobytes()
            digest = hashlib.blake2b(word.lower() if self.lower else word, digest_size=8).digest()
            hashed[i] = int.from_bytes(digest, "little")
        return Words(data, offsets, start, end, np.searchsorted(start, offsets), hashed, total, self.inverse)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of a text column, in pieces of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(max(to, row + 1), len(column))
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
