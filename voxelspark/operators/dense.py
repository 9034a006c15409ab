"""Neighbourhood operators on one dense block of a volume, in numpy: what a worker does with a tile."""

from __future__ import annotations

import math

import numpy as np


def _faces(n: int):
    """For each of the six faces the places that have a neighbour there, and those neighbours."""
    for axis in range(n):
        low = tuple(slice(None, -1) if a == axis else slice(None) for a in range(n))
        high = tuple(slice(1, None) if a == axis else slice(None) for a in range(n))
        yield low, high
        yield high, low


def maxima(v: np.ndarray) -> np.ndarray:
    """Cells of plateaus (equal values joined over faces) without any higher face neighbour; nothing lies outside the block."""
    bad = np.zeros(v.shape, bool)
    for here, there in _faces(v.ndim):
        bad[here] |= v[there] > v[here]
    while True:
        # what stands beside a spoilt cell of its own height is spoilt
        more = bad.copy()
        for here, there in _faces(v.ndim):
            more[here] |= bad[there] & (v[there] == v[here])
        if (more == bad).all():
            return ~bad
        bad = more


def soft_kernel(radius: float) -> np.ndarray:
    """One axis of the Gaussian of deviation radius/2 with peak 1, on a cube of half-size ``int(radius + 1)``."""
    d = np.arange(-int(radius + 1), int(radius + 1) + 1)
    return np.exp(-(d * d) / (2 * (radius / 2) ** 2))


def ball_sums(v: np.ndarray, radius: float, soft: bool) -> tuple[np.ndarray, float]:
    """(sum of the neighbourhood of each cell, sum of its weights); outside the block is 0."""
    if soft:
        k = soft_kernel(radius)
        out = v.astype(float)
        for axis in range(v.ndim):
            out = np.apply_along_axis(lambda line: np.convolve(line, k)[len(k) // 2 : len(k) // 2 + len(line)], axis, out)
        return out, float(k.sum() ** v.ndim)
    r = int(radius)
    wide = np.pad(v.astype(float), r)
    # along the last axis a run of cells is a difference of running sums
    sums = np.concatenate([np.zeros((*wide.shape[:2], 1)), np.cumsum(wide, axis=2)], axis=2)
    out, cells = np.zeros(v.shape), 0
    for a in range(-r, r + 1):
        for b in range(-r, r + 1):
            if (left := radius * radius - a * a - b * b) >= 0:
                c = int(math.isqrt(int(left)))
                rows = sums[r + a : r + a + v.shape[0], r + b : r + b + v.shape[1]]
                out += rows[:, :, r + c + 1 : r + c + 1 + v.shape[2]] - rows[:, :, r - c : r - c + v.shape[2]]
                cells += 2 * c + 1
    return out, float(cells)


class Cells:
    """Points in a cell list of side ``radius``."""

    STEPS = tuple((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))

    def __init__(self, points: np.ndarray, radius: float):
        self.points, self.radius = points, radius
        held: dict[tuple, list[int]] = {}
        for k, c in enumerate(map(tuple, np.floor(points / radius).astype(int).tolist())):
            held.setdefault(c, []).append(k)
        self.held = {c: np.array(v) for c, v in held.items()}

    def near(self, at: np.ndarray) -> np.ndarray:
        """Indices of the points within the radius, ends included."""
        home = np.floor(at / self.radius).astype(int).tolist()
        found = [self.held[k] for s in self.STEPS if (k := (home[0] + s[0], home[1] + s[1], home[2] + s[2])) in self.held]
        if not found:
            return np.zeros(0, int)
        found = np.concatenate(found)
        return found[((self.points[found] - at) ** 2).sum(axis=1) <= self.radius**2]


class Crowd:
    """Points in cells half a radius wide; sums of their ``values`` (a row a point) are taken for all places of a cell at once."""

    def __init__(self, points: np.ndarray, values: np.ndarray, radius: float, pairs: int = 1 << 18):
        # a little wider, so that what is within the radius is never three cells away
        self.radius, self.side, self.pairs = radius, radius / 2 * (1 + 1e-9), pairs
        cell = np.floor(points / self.side).astype(np.int64)
        self.low = cell.min(axis=0)
        self.size = cell.max(axis=0) - self.low + 1
        code = np.ravel_multi_index(tuple((cell - self.low).T), tuple(self.size))
        order = np.argsort(code, kind="stable")
        self.points, self.values, self.code, self.held = np.ascontiguousarray(points[order].T), values[order], code[order], {}

    def _near(self, cell: tuple) -> np.ndarray:
        """The points of the cells up to two away, which follow each other along the last axis."""
        if cell not in self.held:
            first, last = np.maximum(np.array(cell) - 2, 0), np.minimum(np.array(cell) + 2, self.size - 1)
            line = (np.arange(first[0], last[0] + 1)[:, None] * self.size[1] + np.arange(first[1], last[1] + 1)).ravel() * self.size[2]
            ends = zip(np.searchsorted(self.code, line + first[2], "left").tolist(), np.searchsorted(self.code, line + last[2], "right").tolist(), strict=True)
            self.held[cell] = np.concatenate([np.zeros(0, np.int64), *[np.arange(i, j) for i, j in ends if i < j]])
        return self.held[cell]

    def sums(self, at: np.ndarray) -> np.ndarray:
        """Sums over the points within the radius of each place, ends included."""
        out = np.zeros((len(at), self.values.shape[1]))
        cell = np.floor(at / self.side).astype(np.int64) - self.low
        order = np.lexsort(cell.T)
        starts = np.flatnonzero(np.append(True, (np.diff(cell[order], axis=0) != 0).any(axis=1)))
        for s, e in zip(starts, [*starts[1:], len(at)], strict=True):
            near = self._near(tuple(cell[order[s]].tolist()))
            if not len(near):
                continue
            points, values = self.points[:, near], self.values[near]
            step = max(1, self.pairs // len(near))
            for k in range(s, e, step):
                some = order[k : min(e, k + step)]
                d = np.subtract.outer(at[some, 0], points[0])
                d *= d
                for axis in (1, 2):
                    gap = np.subtract.outer(at[some, axis], points[axis])
                    gap *= gap
                    d += gap
                out[some] = (d <= self.radius**2).astype(float) @ values
        return out


def climb(cells: Cells, weight: np.ndarray, seed: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, int, float] | None:
    """(where a seed comes to rest, points and summed weight of the ball its last step looked at); None if there is nothing in reach.

    It rests after a step under a thousandth of the radius, or after ``rounds`` steps more than one.
    """
    at, done = seed.astype(float), 0
    while True:
        near = cells.near(at)
        total = weight[near].sum()
        if not len(near) or not total:
            return None
        new = (cells.points[near] * weight[near, None]).sum(axis=0) / total
        moved, at = np.sqrt(((new - at) ** 2).sum()), new
        if moved < 1e-3 * cells.radius or done == rounds:
            return at, len(near), float(total)
        done += 1


def spread_out(centres: np.ndarray, order: np.ndarray, radius: float) -> np.ndarray:
    """Of centres visited in ``order`` those that no kept one lies within ``radius`` of, in that order."""
    cells, gone, kept = Cells(centres, radius), np.zeros(len(centres), bool), []
    for k in order:
        if not gone[k]:
            kept.append(k)
            gone[cells.near(centres[k])] = True
    return np.array(kept, int)


def rest_points(points: np.ndarray, weight: np.ndarray, seeds: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, volumes, masses) of weighted mean shift from ``seeds``: equal centres are one (the last one's figures hold), near ones the heaviest."""
    cells, found = Cells(points, radius), {}
    for s in seeds:
        if (end := climb(cells, weight, s)) is not None:
            found[tuple(end[0].tolist())] = end[1:]
    if not found:
        return np.zeros((0, 3)), np.zeros(0, int), np.zeros(0)
    centres, volumes, masses = np.array(list(found)), np.array([v for v, _ in found.values()]), np.array([m for _, m in found.values()])
    kept = spread_out(centres, np.argsort(-masses, kind="stable"), radius)
    return centres[kept], volumes[kept], masses[kept]
