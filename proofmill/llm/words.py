"""Words, lines and hashes of whole Arrow batches of text, on their UTF-8 bytes.

White space is space and the characters 09 to 0D; all of them are single
bytes, so a word found on bytes is the word found on characters.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in chunks of about `limit` bytes: first and last row, bytes,
    and where each text starts. A longer text is a chunk of its own."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


@dataclass
class Words:
    """The words of a chunk: bytes from `start` to `end`, the text they stand in, a hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    counts: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each run of n words inside a text, and the run's hash."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:len(self.text) - n + 1] == self.text[n - 1:])
        h = self.hash[at]
        for i in range(1, n):
            h = mixed(h * np.uint64(_BASE) + self.hash[at + i])
        return at, h


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes: its pieces of eight bytes, each mixed with
    its number, are added up. No word of letters makes the sums meet by form, as
    polynomials of a power of two do."""
    size = end - start
    pieces = np.maximum(-(-size // 8), 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.append(0, np.cumsum(pieces)[:-1])
    number = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(start, pieces) + 8 * number
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[np.minimum(at, len(data))]
    left = np.clip(np.repeat(end, pieces) - at, 0, 8).astype(np.uint64)
    eights &= np.where(left == 8, np.uint64((1 << 64) - 1), (np.uint64(1) << (left % np.uint64(8) * np.uint64(8))) - np.uint64(1))
    seed = mixed((number.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    return mixed(np.add.reduceat(mixed(eights ^ seed), first) + size.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~SPACES[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    begins[bounds] = solid[bounds]
    ends[bounds - 1] = solid[bounds - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return Words(start, end, np.repeat(np.arange(len(counts)), counts), spans_hash(data, start, end), counts)
