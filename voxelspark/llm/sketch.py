"""Count-min sketch kept to what a "seen more than once?" question needs: two bit planes a row.

Cells saturate at two, so a cell is one bit in the plane "at least one" and one in the plane "at least
two". Sketches of partitions are merged cell by cell in a shuffle over fixed chunks; only the merged
plane "at least two" goes to the driver, and its size is set by ``log2_cells``, not by the input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelspark.llm.arrays import mix
from voxelspark.llm.workers import release, tidy

CHUNK_BITS = 20
#: Largest width of a row: 2**28 cells are 32 MB a plane.
MAX_LOG2_CELLS, MIN_LOG2_CELLS = 28, 16
SCHEMA = "chunk int, once binary, twice binary"


def log2_cells(items: int, cells_an_item: float) -> int:
    """Width that gives ``items`` so many cells each, within the fixed bounds."""
    return min(MAX_LOG2_CELLS, max(MIN_LOG2_CELLS, math.ceil(math.log2(max(1.0, items * cells_an_item)))))


def _or_into(plane: np.ndarray, cells: np.ndarray) -> None:
    """Set the bits of sorted distinct cells."""
    if len(cells):
        at, bit = (cells >> np.uint64(3)).astype(np.int64), np.left_shift(1, (cells & np.uint64(7)).astype(np.int64)).astype(np.uint8)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        plane[at[starts]] |= np.bitwise_or.reduceat(bit, starts)


def _has(plane: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (plane[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Sketch:
    def __init__(self, log2: int, depth: int):
        self.log2, self.depth = log2, depth
        self.once, self.twice = (np.zeros((depth, 1 << max(0, log2 - 3)), np.uint8) for _ in range(2))

    def _cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return mix(keys, 101 + row) >> np.uint64(64 - self.log2)

    def add(self, keys: np.ndarray) -> None:
        """Count each key once more for every time it stands in ``keys``."""
        for row in range(self.depth):
            cells, counts = np.unique(self._cells(keys, row), return_counts=True)
            _or_into(self.twice[row], cells[(counts > 1) | _has(self.once[row], cells)])
            _or_into(self.once[row], cells)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimate of each key is two or more; never false for a key added twice."""
        out = np.ones(len(keys), bool)
        for row in range(self.depth):
            out[out] = _has(self.twice[row], self._cells(keys[out], row))
        return out

    def single(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key was surely not added twice."""
        return ~self.repeated(keys)

    def chunks(self) -> Iterator[pa.RecordBatch]:
        once, twice = self.once.reshape(-1), self.twice.reshape(-1)
        size = min(len(once), 1 << (CHUNK_BITS - 3))
        for k in range(len(once) // size):
            part = slice(k * size, (k + 1) * size)
            if once[part].any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "once": [zlib.compress(once[part].tobytes(), 1)], "twice": [zlib.compress(twice[part].tobytes(), 1)]})


class Slices(Sketch):
    """Row ``r`` counts the keys of slice ``first + r`` of ``of`` alone, so that many keys needn't share the cells of a row."""

    def __init__(self, log2: int, depth: int, first: int = 0, of: int = 1):
        super().__init__(log2, depth)
        self.first, self.of = first, of

    def _own(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 131) % np.uint64(self.of)).astype(np.int64) - self.first

    def add(self, keys: np.ndarray) -> None:
        own = self._own(keys)
        for row in range(self.depth):
            cells, counts = np.unique(self._cells(keys[own == row], row), return_counts=True)
            _or_into(self.twice[row], cells[(counts > 1) | _has(self.once[row], cells)])
            _or_into(self.once[row], cells)

    def single(self, keys: np.ndarray) -> np.ndarray:
        """Keys of these slices that surely weren't added twice; nothing is known of others."""
        own, out = self._own(keys), np.zeros(len(keys), bool)
        for row in range(self.depth):
            at = np.flatnonzero(own == row)
            out[at] = ~_has(self.twice[row], self._cells(keys[at], row))
        return out


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint8)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge chunks that arrive sorted by number; holds one chunk at a time."""
    at, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "once": [b""], "twice": [zlib.compress(twice.tobytes(), 1)]})

    for batch in batches:
        for k, a, b in zip(batch["chunk"].to_pylist(), batch["once"], batch["twice"], strict=True):
            a, b = _unpack(a.as_py()), _unpack(b.as_py())
            if k == at:
                twice |= b | (once & a)
                once |= a
            else:
                if at is not None:
                    yield done()
                at, once, twice = k, a.copy(), b.copy()
    if at is not None:
        yield done()


def build(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2: int, depth: int, tasks: int | None = None, kind: Callable[[int, int], Sketch] = Sketch) -> Sketch:
    """Sketch (of a ``kind``) of all keys that ``keys`` draws from the batches of ``df``: one partial sketch a partition, merged.

    The returned sketch answers ``repeated`` and ``single`` only.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = kind(log2, depth)
        for batch in batches:
            for found in keys(batch):
                sketch.add(found)
        yield from sketch.chunks()

    n = tasks or max(1, min(64, (depth << log2) >> CHUNK_BITS))
    merged = df.mapInArrow(tidy(partial), SCHEMA).repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(tidy(_merge), SCHEMA)
    out = kind(log2, depth)
    out.once = None
    flat = out.twice.reshape(-1)
    size = min(len(flat), 1 << (CHUNK_BITS - 3))
    for k, part in merged.select("chunk", "twice").collect():
        flat[k * size : (k + 1) * size] = _unpack(bytes(part))
    release()
    return out
