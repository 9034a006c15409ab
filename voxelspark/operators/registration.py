"""Rigid motions as columns, and registration of two volumes by mutual information."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.storage import cut
from voxelspark.operators import kernels

AXES = ("x", "y", "z")
Rows = tuple[tuple[Column, Column, Column], ...]


def compose_columns(first: tuple[Rows, tuple[Column, ...]], second: tuple[Rows, tuple[Column, ...]]) -> tuple[Rows, tuple[Column, ...]]:
    """Rotation rows and shift of one motion a row for two, the first one done first."""
    (ra, ta), (rb, tb) = first, second
    times = lambda row, column: row[0] * column[0] + row[1] * column[1] + row[2] * column[2]
    r = tuple(tuple(times(rb[i], [ra[k][j] for k in range(3)]) for j in range(3)) for i in range(3))
    return r, tuple(times(rb[i], ta) + tb[i] for i in range(3))


@dataclass
class Fit:
    """Unit quaternion (vector part), shift, centre of rotation and the metric reached."""

    turn: np.ndarray
    shift: np.ndarray
    centre: np.ndarray
    metric: float

    def rotation(self) -> np.ndarray:
        return rotation(self.turn)


def rotation(turn: np.ndarray) -> np.ndarray:
    """Matrix of the unit quaternion with this vector part (its length is below one)."""
    x, y, z = turn
    w = np.sqrt(max(0.0, 1.0 - x * x - y * y - z * z))
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def metrics(fixed: DataFrame, moving: DataFrame, motions: list[tuple[np.ndarray, np.ndarray]], centre: np.ndarray, bins: int = 32) -> list[float]:
    """Mutual information of the fixed volume with the moving one under each motion, all counted in one job.

    A motion takes a fixed voxel to a place in the moving volume, whose value there is interpolated from eight voxels
    (absent ones are 0). Intensities are 0 to 255; places are in voxels of the tables at hand.
    """
    rows = [F.struct(F.lit(k).alias("k"), *[F.lit(float(v)).alias(f"r{i}{j}") for i, row in enumerate(r) for j, v in enumerate(row)], *[F.lit(float(v)).alias(f"t{i}") for i, v in enumerate(t)]) for k, (r, t) in enumerate(motions)]
    points = fixed.select(*AXES, F.least(F.floor(F.col("intensity") * bins / 256), F.lit(bins - 1)).cast("int").alias("f")).withColumn("m", F.explode(F.array(*rows)))
    away = [F.col(a) - float(c) for a, c in zip(AXES, centre, strict=True)]
    at = [sum(F.col(f"m.r{i}{j}") * away[j] for j in range(3)) + F.col(f"m.t{i}") + float(centre[i]) for i in range(3)]
    key = F.struct(F.col("m.k").alias("k"), *AXES, "f")
    values = kernels.resample_linear(moving, points.select(key.alias("id"), *[v.alias(a) for v, a in zip(at, AXES, strict=True)]))
    joint = values.groupBy(F.col("id.k").alias("k"), F.col("id.f").alias("f"), F.least(F.floor(F.col("value") * bins / 256), F.lit(bins - 1)).cast("int").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    # a table of motions x bins x bins
    counts = np.zeros((len(motions), bins, bins))
    for k, f, m, n in joint.collect():
        counts[k, f, m] = n
    return [information(c) for c in counts]


def information(counts: np.ndarray) -> float:
    p = counts / max(1.0, counts.sum())
    expected = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
    some = p > 0
    return float((p[some] * np.log(p[some] / expected[some])).sum())


#: Fixed values of the metric: bins of both intensities, of which so many at each end stay free for the kernel.
BINS, PADDING = 50, 2
#: Samples that must land inside the moving volume, as a part of all.
LEAST_INSIDE = 1 / 16
#: Rows of corners up to which the sample is sent to the moving volume, which then stays where it is.
BROADCAST_ROWS = 2_000_000
#: A step whose shift is shorter ends a level.
LEAST_SHIFT = 1e-4


def _range(volume: DataFrame, size: tuple[int, int, int]) -> tuple[float, float]:
    """Least and greatest intensity of a whole volume; absent voxels are 0."""
    low, high, n = volume.agg(F.min("intensity"), F.max("intensity"), F.count(F.lit(1))).first()
    low, high = float(low or 0), float(high or 0)
    return (low, high) if n == int(np.prod(size)) else (min(0.0, low), max(0.0, high))


@dataclass(frozen=True)
class Scale:
    """Bins of one image's intensities."""

    low: float
    width: float
    bins: int

    @classmethod
    def of(cls, low: float, high: float, bins: int) -> Scale:
        return cls(low, max(high - low, 1e-12) / (bins - 2 * PADDING), bins)

    def place(self, v: Column) -> Column:
        """Where a value lies among the bins, a real number."""
        return (v - self.low) / self.width + PADDING

    def bin(self, v: Column) -> Column:
        return F.least(F.greatest(F.floor(self.place(v)), F.lit(PADDING)), F.lit(self.bins - PADDING - 1)).cast("int")


def cubic(u: Column) -> Column:
    """The cubic B-spline."""
    a = F.abs(u)
    return F.when(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)


def cubic_slope(u: Column) -> Column:
    a = F.abs(u)
    return F.signum(u) * F.when(a < 1, a * (9 * a - 12) / 6).when(a < 2, -(2 - a) * (2 - a) / 2).otherwise(0.0)


def turned(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of a quaternion (x, y, z, w), its slopes by the four); a rotation where its length is 1."""
    x, y, z, w = q
    r = np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]])
    slopes = 2 * np.array(
        [
            [[x, y, z], [y, -x, -w], [z, w, -x]],
            [[-y, x, w], [x, y, z], [-w, z, -y]],
            [[-z, -w, x], [w, -z, y], [x, y, z]],
            [[w, -z, y], [z, w, -x], [-y, x, w]],
        ]
    )
    return r, slopes


def sample(fixed: DataFrame, size: tuple[int, int, int], n: int, scale: Scale, seed: int = 0) -> DataFrame:
    """``id, x, y, z, f``: about ``n`` places of the fixed volume with the bin of their value, drawn by number without touching the others.

    Places are numbers below the volume's size, drawn by a seeded hash, each once; where no voxel lies the value is 0.
    """
    cells = int(np.prod(size))
    spark = fixed.sparkSession
    numbers = spark.range(cells) if n >= cells else spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(cells)).alias("id")).distinct()
    at = numbers.select("id", F.floor(F.col("id") / (size[1] * size[2])).cast("int").alias("x"), (F.floor(F.col("id") / size[2]) % size[1]).cast("int").alias("y"), (F.col("id") % size[2]).cast("int").alias("z"))
    # the sample is what is sent, not the volume
    side = F.broadcast(at) if n <= BROADCAST_ROWS else at
    found = fixed.select(*AXES, "intensity").join(side, list(AXES)).select("id", "intensity")
    return cut(at.join(found, "id", "left").select("id", *AXES, scale.bin(F.coalesce("intensity", F.lit(0))).alias("f")))


def mattes(points: DataFrame, moving: DataFrame, size: tuple[int, int, int], parameters: np.ndarray, centre: np.ndarray, scale: Scale, n: int | None = None, factors: tuple[int, int, int] = (1, 1, 1)) -> tuple[float, np.ndarray]:
    """(mutual information, its slopes by the seven parameters) of a sample ``id, x, y, z, f`` under one motion, in one job.

    ``parameters`` are a quaternion (x, y, z, w) and a shift; a place p goes to ``R (p - centre) + centre + shift``. Values
    and their slopes there are those of the trilinear interpolation between eight voxels; a sample that lands outside
    the box of the voxels takes no part. The moving intensity is spread over four bins by a cubic B-spline, so the joint
    shares have slopes, and those are summed beside them, a row a pair of bins: with ``p`` the shares and ``m`` those of the
    moving image alone the information's slope is the sum over bins of ``p' ln(p / m)``.
    """
    r, slopes = turned(parameters[:4])
    away = [F.col(a) - float(c) for a, c in zip(AXES, centre, strict=True)]
    dot = lambda row: sum((float(v) * c for v, c in zip(row, away, strict=True)), F.lit(0.0))
    to = points.select("id", "f", *AXES, *[((dot(r[i]) + float(centre[i] + parameters[4 + i] - (factors[i] - 1) / 2)) / factors[i]).alias(f"t{a}") for i, a in enumerate(AXES)])
    for a, w in zip(AXES, size, strict=True):
        to = to.where(F.col(f"t{a}").between(0.0, float(w - 1)))
    corner = F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(AXES, k, strict=True)]) for k in np.ndindex(2, 2, 2)])).alias("k")
    # the last plane of cells has its upper corner inside as well
    base = {a: F.least(F.floor(f"t{a}"), F.lit(max(0, w - 2))).cast("int") for a, w in zip(AXES, size, strict=True)}
    placed = to.select("*", *[b.alias(f"b{a}") for a, b in base.items()]).select("*", corner)
    part = {a: F.col(f"t{a}") - F.col(f"b{a}") for a in AXES}
    weight = {a: F.when(F.col(f"k.{a}") == 1, part[a]).otherwise(1 - part[a]) for a in AXES}
    slope = {a: F.when(F.col(f"k.{a}") == 1, 1.0).otherwise(-1.0) for a in AXES}
    term = {None: weight["x"] * weight["y"] * weight["z"]} | {a: slope[a] * weight[AXES[(i + 1) % 3]] * weight[AXES[(i + 2) % 3]] for i, a in enumerate(AXES)}
    corners = placed.select("id", *[(F.col(f"b{a}") + F.col(f"k.{a}")).cast("int").alias(f"c{a}") for a in AXES], term[None].alias("w"), *[term[a].alias(f"w{a}") for a in AXES])
    side = F.broadcast(corners) if n is not None and 8 * n <= BROADCAST_ROWS else corners
    held = moving.select(*[F.col(a).alias(f"c{a}") for a in AXES], "intensity").join(side, [f"c{a}" for a in AXES])
    sums = held.groupBy("id").agg(F.sum(F.col("w") * F.col("intensity")).alias("v"), *[F.sum(F.col(f"w{a}") * F.col("intensity")).alias(f"g{a}") for a in AXES])
    met = to.join(sums, "id", "left").fillna(0.0, ["v", "gx", "gy", "gz"])
    # slope of the value by each parameter: the volume's slope times that of the place
    steep = [F.col(f"g{a}") / f for a, f in zip(AXES, factors, strict=True)]
    by = [sum((steep[i] * dot(slopes[k][i]) for i in range(3)), F.lit(0.0)) for k in range(4)] + steep
    u = scale.place(F.col("v"))
    spread = met.select("f", u.alias("u"), scale.bin(F.col("v")).alias("b"), *[c.alias(f"d{k}") for k, c in enumerate(by)]).select("*", F.explode(F.array(*[F.col("b") + j for j in (-1, 0, 1, 2)])).alias("m"))
    far = F.col("m") - F.col("u")
    joint = spread.groupBy("f", "m").agg(F.sum(cubic(far)).alias("n"), *[F.sum(-cubic_slope(far) * F.col(f"d{k}") / scale.width).alias(f"s{k}") for k in range(7)])
    p, s = np.zeros((scale.bins, scale.bins)), np.zeros((7, scale.bins, scale.bins))
    for row in joint.collect():
        p[row["f"], row["m"]] = row["n"]
        s[:, row["f"], row["m"]] = [row[f"s{k}"] for k in range(7)]
    if not p.sum():
        return 0.0, np.zeros(7)
    s, p = s / p.sum(), p / p.sum()
    own, expected = p.sum(axis=0), p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
    some = p > 1e-16
    ratio = np.log(np.where(some, p, 1.0) / np.where(some, own, 1.0))
    return float((p[some] * np.log(p[some] / expected[some])).sum()), (s * np.where(some, ratio, 0.0)).sum(axis=(1, 2))


def inside_share(points: DataFrame, size: tuple[int, int, int], parameters: np.ndarray, centre: np.ndarray) -> float:
    """Part of the sample that a motion takes into the box of the moving volume."""
    r, _ = turned(parameters[:4])
    test = F.lit(True)
    for i, w in enumerate(size):
        t = sum((float(v) * (F.col(a) - float(c)) for v, a, c in zip(r[i], AXES, centre, strict=True)), F.lit(0.0)) + float(centre[i] + parameters[4 + i])
        test = test & t.between(0.0, float(w - 1))
    n, good = points.agg(F.count(F.lit(1)), F.count_if(test)).first()
    return good / n if n else 0.0


@dataclass
class Level:
    """One level of a registration: how far the volumes are shrunk (by axis), steps, the rate of a step."""

    fixed: tuple[int, int, int]
    moving: tuple[int, int, int]
    iterations: int
    rate: float


def shrink(volume: DataFrame, factors: tuple[int, int, int]) -> DataFrame:
    """Mean of each block of voxels, absent ones as 0 (a block's last voxels may be missing at the volume's end)."""
    by = [F.floor(F.col(a) / f).cast("int").alias(a) for a, f in zip(AXES, factors, strict=True)]
    return volume.groupBy(*by).agg((F.sum("intensity") / int(np.prod(factors))).alias("intensity"))


def plan(parameters: dict[str, list[float]]) -> list[Level]:
    """The levels of a parameter file: shrink factors are those of the first level and halve from level to level."""
    n = int(parameters["levels"][0])
    factors = lambda name, k: tuple(max(1, int(f) >> k) for f in parameters[name])
    return [Level(factors("fixed_shrink", k), factors("moving_shrink", k), int(parameters["iterations"][k]), float(parameters["rates"][k])) for k in range(n)]


def descend(fixed: DataFrame, moving: DataFrame, size: tuple[int, int, int], moving_size: tuple[int, int, int], levels: list[Level], samples: int = 50, translation_scale: float = 1.0, start: np.ndarray | None = None, seed: int = 0, log: list | None = None) -> Fit:
    """Rigid motion from the fixed to the moving volume by steps along the slopes of mutual information over a sample.

    A step adds ``rate`` times the slopes to the quaternion, which is scaled back to length 1, and ``rate / translation_scale``
    times them to the shift. A level ends after its iterations or when a shift is below ``LEAST_SHIFT``. What a step reads
    of the fixed volume is its sample. Raises where too few samples land inside the moving volume.
    """
    at = np.array([0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]) if start is None else np.asarray(start, float)
    centre, value = (np.array(size, float) - 1) / 2, 0.0
    for number, level in enumerate(levels):
        a, b = (v if f == (1, 1, 1) else cut(shrink(v, f)) for v, f in ((fixed, level.fixed), (moving, level.moving)))
        fs, ms = (tuple(-(-w // f) for w, f in zip(s, fac, strict=True)) for s, fac in ((size, level.fixed), (moving_size, level.moving)))
        n = min(samples, int(np.prod(fs)))
        drawn = sample(a, fs, samples, Scale.of(*_range(a, fs), BINS), seed + number)
        # places of a level stand for the middles of their blocks; both volumes are then taken in full voxels
        whole = drawn.select("id", "f", *[(F.col(c) * f + (f - 1) / 2).alias(c) for c, f in zip(AXES, level.fixed, strict=True)])
        scale = Scale.of(*_range(b, ms), BINS)
        for k in range(level.iterations):
            if k == 0 and inside_share(whole, moving_size, at, centre) < LEAST_INSIDE:
                raise ValueError("too few samples land inside the moving volume")
            value, slopes = mattes(whole, b, ms, at, centre, scale, n, level.moving)
            turn, step = at[:4] + level.rate * slopes[:4], level.rate / translation_scale * slopes[4:]
            at = np.concatenate([turn / np.sqrt((turn**2).sum()), at[4:] + step])
            if log is not None:
                log.append((number, k, value, *at))
            if np.sqrt((step**2).sum()) < LEAST_SHIFT:
                break
    sign = 1.0 if at[3] >= 0 else -1.0
    return Fit(sign * at[:3], at[4:], centre, value)


def register(fixed: DataFrame, moving: DataFrame, levels: tuple[tuple[int, int], ...] = ((4, 10), (2, 10)), bins: int = 32, first_step: float = 1.0, least_step: float = 1e-2, samples: int = 50_000, seed: int = 0) -> Fit:
    """Rigid motion from the fixed to the moving volume by ascent of mutual information, coarse levels first.

    ``levels`` are (shrink factor, rounds). A round moves by the step along the slopes over a sample; a step that doesn't
    improve the metric is taken back and halved, down to ``least_step`` blocks of the level.
    """
    ends = [v.agg(*[F.max(a) for a in AXES]).first() for v in (fixed, moving)]
    if any(e is None for row in ends for e in row):
        return Fit(np.zeros(3), np.zeros(3), np.zeros(3), 0.0)
    size = tuple(max(int(a), int(b)) + 1 for a, b in zip(*ends, strict=True))
    at, centre, best = np.array([0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (np.array(size, float) - 1) / 2, 0.0
    lever = max(size) / 2
    for number, (factor, rounds) in enumerate(levels):
        f = (factor,) * 3
        a, b = (cut(shrink(v, f)) for v in (fixed, moving))
        small = tuple(-(-w // factor) for w in size)
        drawn = sample(a, small, samples, Scale.of(*_range(a, small), bins), seed + number)
        points = drawn.select("id", "f", *[(F.col(c) * factor + (factor - 1) / 2).alias(c) for c in AXES])
        scale, n = Scale.of(*_range(b, small), bins), min(samples, int(np.prod(small)))
        climb = lambda p, points=points, b=b, small=small, scale=scale, n=n, f=f: mattes(points, b, small, p, centre, scale, n, f)
        # in units of a block's move at the volume's end, so that turns and shifts weigh alike
        unit = np.array([1 / lever] * 4 + [1.0] * 3) * factor
        step = first_step
        best, slopes = climb(at)
        for _ in range(rounds):
            along = slopes * unit
            along[:4] -= at[:4] * (along[:4] @ at[:4])
            length = np.sqrt((along**2).sum())
            if length == 0 or step < least_step:
                break
            new = at + along / length * step * unit
            new[:4] /= np.sqrt((new[:4] ** 2).sum())
            value, there = climb(new)
            if value > best:
                at, best, slopes = new, value, there
            else:
                step /= 2
    sign = 1.0 if at[3] >= 0 else -1.0
    return Fit(sign * at[:3], at[4:], centre, best)


def from_parameters(fixed: DataFrame, moving: DataFrame, size: tuple[int, int, int], moving_size: tuple[int, int, int], parameters: dict[str, list[float]], seed: int = 0, log: list | None = None) -> Fit:
    """The registration that a parameter file describes.

    Axes of the moving volume are permuted and flipped first. Metric 1 is mutual information; 2, which its file calls
    normalised, has the same value and slopes. Metric 0, a kernel estimate of it on two samples, is not offered.
    """
    if int(parameters["metric"][0]) not in (1, 2):
        raise ValueError("metrics 1 and 2 are offered")
    order, flip = [int(v) for v in parameters["permute"]], [bool(int(v)) for v in parameters["flip"]]
    turned_size = tuple(moving_size[k] for k in order)
    away = [(F.lit(w - 1) - F.col(AXES[k]) if f else F.col(AXES[k])).cast("int").alias(a) for a, k, f, w in zip(AXES, order, flip, turned_size, strict=True)]
    parameters = parameters | {"moving_shrink": [parameters["moving_shrink"][k] for k in order]}
    return descend(fixed, moving.select(*away, "intensity"), size, turned_size, plan(parameters), int(parameters["samples"][0]), float(parameters["translation_scale"][0]), seed=seed, log=log)
