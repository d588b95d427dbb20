"""Vectorised words and hashes over Arrow string columns.

Texts stay UTF-8 bytes. All word classes used here are decided by single bytes (every byte of a
non-ASCII character is 0x80 or more), so one table lookup marks word bytes, and a prefix sum of
``table[byte] * base**position`` modulo 2**64 gives the hash of every word at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


_known_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _known_powers or len(_known_powers[0][0]) < n:
        size = CHUNK_BYTES + 1
        while size < n:
            size *= 2
        _known_powers[:] = [_powers(size)]
    return _known_powers[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h


class Chunk:
    """Some consecutive rows of a batch: the bytes of their texts and where each text begins."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets, self.rows = first, buf, offsets, len(offsets) - 1

    def lowered(self) -> Chunk:
        return Chunk(self.first, LOWER[self.buf], self.offsets)

    def words(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the row of each."""
        n = len(self.buf)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        mark = keep[self.buf]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0] = after[-1] = False
        before[1:], after[:-1] = mark[:-1], mark[1:]
        cut = self.offsets[1:-1]
        before[cut[cut < n]] = False
        after[cut[cut > 0] - 1] = False
        starts, ends = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def prefix_hash(self) -> np.ndarray:
        up, _ = powers(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.buf] * up[: len(self.buf)], out=sums[1:])
        return sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        sums = self.prefix_hash()
        _, down = powers(len(self.buf) + 1)
        h = sums[ends]
        h -= sums[starts]
        h *= down[starts]
        return mix(h)


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = 1000) -> Iterator[Chunk]:
    """The texts of a column without nulls, in chunks of about ``max_bytes``; a longer text is a chunk of its own."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        stop = min(stop, n, at + max_rows)
        yield Chunk(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end, a space after each, and where each begins (and the end)."""
    sizes = ends - starts + 1
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    out = np.full(offsets[-1], 32, np.uint8)
    into = np.ones(offsets[-1], bool)
    into[offsets[1:] - 1] = False
    into = np.flatnonzero(into)
    out[into] = buf[into + np.repeat(starts - offsets[:-1], sizes - 1)]
    return out, offsets


def text_hash(text: str | bytes) -> int:
    """The hash that :meth:`Chunk.hashes` gives one whole text."""
    raw = text.encode() if isinstance(text, str) else text
    chunk = Chunk(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return int(chunk.hashes(np.array([0]), np.array([len(raw)]))[0])


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and the index of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[: n] == row[k - 1 :])
    out = np.zeros(len(first), np.uint64)
    for i in range(k):
        out *= _BASE
        out += h[first + i]
    return mix(out), first


def find_sorted(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, at, -1)


def per_row(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, rows)
