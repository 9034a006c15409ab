"""Vectorised text helpers for Arrow batches: words, word hashes and n-gram hashes as flat arrays.

Words are ``[^\\x20\\x09-\\x0D]+``. The separators are ASCII, so a word never cuts a UTF-8 sequence
and everything works on the bytes of a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Hash in pieces of at most so many bytes or items; bounds the temporary arrays of a worker.
PIECE = 1 << 20


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown when asked for more."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.n = 0

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 12)
            self.up, self.down = (self._run(b) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    def _run(self, base: int) -> np.ndarray:
        out = np.full(self.n, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTES, _HIGH, _LOW = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift rounds)."""
    h = h + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``size`` bytes together (a longer text is one range)."""
    _, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """Words of consecutive rows: byte spans, the row of each word, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _IS_SEP):
        self.rows = len(offsets) - 1
        self.data = data = _LOWER[data] if lower else data
        inside = ~separators[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            cut = np.zeros(len(data) + 1, bool)
            cut[offsets] = True
            first[1:] &= ~inside[:-1] | cut[1:-1]
            last[:-1] &= ~inside[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.bounds = np.searchsorted(self.row, np.arange(self.rows + 1))

    @classmethod
    def of(cls, column: pa.Array, first: int, last: int, lower: bool = False) -> Words:
        return cls(*text_bytes(column.slice(first, last - first)), lower=lower)

    def hashes(self) -> np.ndarray:
        """Polynomial hash of each word's bytes, scrambled with its length."""
        out = np.zeros(len(self.start), U64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            base = self.start[i]
            part = self.data[base : self.end[j - 1]]
            up, down = _BYTES(len(part) + 1)
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], out=sums[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
            i = j
        return out


def grams(h: np.ndarray, k: int, powers: _Powers = _HIGH) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values (runs that cross a row are the caller's to drop)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for i in range(0, n, PIECE):
        part = h[i : min(i + PIECE, n) + k - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[i : i + m] = mix((sums[k:] - sums[:m]) * down[:m])
    return out


def grams128(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every run of ``k`` values."""
    return grams(h, k, _HIGH), grams(h, k, _LOW)


def whole_runs(row: np.ndarray, k: int) -> np.ndarray:
    """Which runs of ``k`` consecutive words stay within one row."""
    return row[: max(0, len(row) - k + 1)] == row[k - 1 :] if len(row) >= k else np.zeros(0, bool)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
