"""Neighbourhood operators on sparse volumes: offsets are exploded and summed by equi keys, voxel by voxel."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
FACES = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))


def _offsets(rows: Iterable[tuple]) -> Column:
    """A constant array of (dx, dy, dz, w)."""
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"), F.lit(float(w)).alias("w")) for a, b, c, w in rows])


def ball(radius: float, soft: bool = False) -> list[tuple[int, int, int, float]]:
    """Offsets of a ball, with weight 1 or a Gaussian of sigma radius/2 with peak 1."""
    r = int(radius)
    cells = [(a, b, c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= radius * radius]
    weight = lambda a, b, c: math.exp(-(a * a + b * b + c * c) / (2 * (radius / 2) ** 2)) if soft else 1.0
    return [(a, b, c, weight(a, b, c)) for a, b, c in cells]


def cube(size: int) -> list[tuple[int, int, int, float]]:
    span = range(-size, size + 1)
    return [(a, b, c, 1.0) for a in span for b in span for c in span]


def shifted(voxels: DataFrame, offsets: Iterable[tuple], *keep: str) -> DataFrame:
    """Every voxel at every offset: the value it hands to that place."""
    columns = [c for c in voxels.columns if c not in AXES]
    moved = voxels.withColumn("o", F.explode(_offsets(offsets)))
    out = moved.select(*[(F.col(a) + F.col(f"o.d{a}")).cast("int").alias(a) for a in AXES], F.col("o.w").alias("w"), *columns, *keep)
    return out.toDF(*out.columns)


def convolve(voxels: DataFrame, offsets: list[tuple[int, int, int, float]]) -> DataFrame:
    """``x, y, z, intensity, local_mass`` at the voxels themselves; outside counts as 0 (symmetric kernels)."""
    sums = shifted(voxels, offsets).groupBy(*AXES).agg(F.sum(F.col("intensity") * F.col("w")).alias("local_mass"))
    return voxels.join(sums, list(AXES))


def regional_maxima(voxels: DataFrame, components) -> DataFrame:
    """Voxels of plateaus (equal values joined over faces) without any higher face neighbour; absent voxels are 0."""
    ids = voxels.withColumn("id", (F.col("x").cast("long") * 1_000_000_007 + F.col("y").cast("long") * 100_003 + F.col("z").cast("long")))
    near = shifted(ids.select(*AXES, F.col("id").alias("nid"), F.col("intensity").alias("nv")), [(*o, 1) for o in FACES]).drop("w")
    pairs = ids.join(near, list(AXES))
    low = pairs.where("nv > intensity").select("id").distinct()
    flat = pairs.where("nv = intensity").select(F.col("id").alias("u"), F.col("nid").alias("v"))
    # only voxels on a plateau of several need components; the others decide for themselves
    on = flat.select(F.col("u").alias("id")).distinct()
    group = components(on, flat)
    spoilt = group.join(low, "id", "left_semi").select("component").distinct()
    out = group.join(spoilt, "component", "left_semi").select("id").unionByName(low.join(on, "id", "left_anti"))
    return ids.join(out, "id", "left_anti").drop("id")


def local_entropy(voxels: DataFrame, size: int, base: float | None = None) -> DataFrame:
    """``x, y, z, entropy`` at the voxels: entropy (natural, or to ``base``) of the values in the cube around; absent voxels are 0."""
    cells = (2 * size + 1) ** 3
    seen = shifted(voxels, cube(size)).groupBy(*AXES, "intensity").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / cells
    by = seen.groupBy(*AXES).agg(F.sum(F.when(F.col("intensity") != 0, -p * F.log(p)).otherwise(0.0)).alias("h"), F.sum(F.when(F.col("intensity") != 0, F.col("n")).otherwise(0)).alias("n"))
    zero = (F.lit(cells) - F.col("n")) / cells
    whole = F.col("h") + F.when(zero > 0, -zero * F.log(zero)).otherwise(0.0)
    return voxels.join(by, list(AXES)).select(*AXES, "intensity", (whole / math.log(base) if base else whole).alias("entropy"))


def density_entropy(voxels: DataFrame, size: int, bins: int, stride: int = 1, start: int = 0) -> DataFrame:
    """``x, y, z, entropy`` at voxels every ``stride`` from ``start`` on each axis: base two, of the density of the values 0 to 255 around in ``bins`` bins.

    A density is a share divided by the width of a bin; absent voxels are 0.
    """
    cells, width = (2 * size + 1) ** 3, 256 / bins
    kept = voxels.select(*AXES, F.floor(F.col("intensity") * bins / 256).cast("int").alias("bin"))
    near = shifted(kept, cube(size))
    on = voxels.select(*AXES)
    for a in AXES:
        near, on = near.where(F.pmod(F.col(a), F.lit(stride)) == start), on.where(F.pmod(F.col(a), F.lit(stride)) == start)
    n = near.join(on, list(AXES)).groupBy(*AXES, "bin").agg(F.count(F.lit(1)).alias("n"))
    by = n.groupBy(*AXES).agg(F.collect_list(F.struct("bin", "n")).alias("b"))
    above = F.aggregate(F.filter("b", lambda s: s["bin"] > 0), F.lit(0).cast("long"), lambda t, s: t + s["n"])
    term = lambda k: F.when(k > 0, -k / cells / width * F.log2(k / cells / width)).otherwise(0.0)
    whole = F.aggregate(F.filter("b", lambda s: s["bin"] > 0), F.lit(0.0), lambda t, s: t + term(s["n"])) + term(F.lit(cells) - above)
    return by.select(*AXES, whole.alias("entropy"))


def content_fusion(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean of two aligned volumes weighted by 100**entropy, rounded half to even."""
    a = first.select(*AXES, F.col("intensity").alias("va"), F.pow(F.lit(100.0), F.col("entropy")).alias("wa"))
    b = second.select(*AXES, F.col("intensity").alias("vb"), F.pow(F.lit(100.0), F.col("entropy")).alias("wb"))
    fused = (F.col("va") * F.col("wa") + F.col("vb") * F.col("wb")) / (F.col("wa") + F.col("wb"))
    return a.join(b, list(AXES)).select(*AXES, F.rint(F.round(fused, 9)).cast("int").alias("intensity"))


def channels(**volumes: DataFrame) -> DataFrame:
    """Aligned volumes as columns (RGB zip); a voxel absent from one is 0 there."""
    out = None
    for name, df in volumes.items():
        part = df.select(*AXES, F.col("intensity").alias(name))
        out = part if out is None else out.join(part, list(AXES), "full")
    return out.fillna(0, list(volumes))


def shrink(voxels: DataFrame, factor: int) -> DataFrame:
    """Pyramid level: mean of each block's voxels."""
    by = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    return voxels.groupBy(*by).agg(F.round(F.avg("intensity"), 6).alias("intensity"))


def patches(voxels: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """``id, patch``: (2s+1)**3 values in row-major z, y, x order around each centre; absent voxels are 0."""
    side = 2 * size + 1
    cells = centres.withColumn("o", F.explode(_offsets(cube(size))))
    pos = (F.col("o.dz") + size) * side * side + (F.col("o.dy") + size) * side + F.col("o.dx") + size
    at = cells.select("id", pos.cast("int").alias("pos"), *[(F.col(a) + F.col(f"o.d{a}")).cast("int").alias(a) for a in AXES])
    values = at.join(voxels, list(AXES), "left").select("id", "pos", F.coalesce("intensity", F.lit(0)).alias("v"))
    return values.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("patch"))


def overlap_add(patches_: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """``x, y, z, total, coverage``: patches laid back over the volume, summed and counted."""
    side = 2 * size + 1
    cells = patches_.join(centres, "id").select(*AXES, F.posexplode("patch").alias("pos", "v"))
    where = {"x": F.col("pos") % side, "y": F.floor(F.col("pos") / side) % side, "z": F.floor(F.col("pos") / (side * side))}
    placed = cells.select(*[(F.col(a) + where[a] - size).cast("int").alias(a) for a in AXES], "v")
    return placed.groupBy(*AXES).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("coverage"))


def resample_nearest(voxels: DataFrame, grid: DataFrame, rotation: tuple[tuple[float, ...], ...], shift: tuple[float, ...], size: tuple[int, int, int]) -> DataFrame:
    """Each grid cell takes the voxel nearest to its inverse image (half to even, strictly inside), else 0."""
    back = [sum((F.col(a) - t) * rotation[j][i] for j, (a, t) in enumerate(zip(AXES, shift, strict=True))) for i in range(3)]
    at = grid.select(*AXES, *[F.rint(b).cast("int").alias(f"s{a}") for a, b in zip(AXES, back, strict=True)])
    test = F.lit(True)
    for a, w in zip(AXES, size, strict=True):
        test = test & (F.col(f"s{a}") > 0) & (F.col(f"s{a}") < w - 1)
    source = voxels.select(*[F.col(a).alias(f"s{a}") for a in AXES], "intensity")
    return at.join(source, ["sx", "sy", "sz"], "left").select(*AXES, F.when(test, F.coalesce("intensity", F.lit(0))).otherwise(0).alias("intensity"))


def resample_linear(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """``id, value``: trilinear value at real coordinates: eight corners, joined and weighted; absent voxels are 0."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    at = points.withColumn("k", corner)
    weight, cells = F.lit(1.0), []
    for axis, bit in zip(AXES, "abc", strict=True):
        low = F.floor(axis)
        part = F.col(axis) - low
        weight = weight * F.when(F.col(f"k.{bit}") == 1, part).otherwise(1 - part)
        cells.append((low + F.col(f"k.{bit}")).cast("int").alias(f"c{axis}"))
    at = at.select("id", weight.alias("w"), *cells)
    source = voxels.select(*[F.col(a).alias(f"c{a}") for a in AXES], "intensity")
    return at.join(source, ["cx", "cy", "cz"], "left").groupBy("id").agg(F.round(F.sum(F.col("w") * F.coalesce("intensity", F.lit(0))), 6).alias("value"))


def full_grid(spark: SparkSession, size: tuple[int, int, int]) -> DataFrame:
    out = None
    for a, n in zip(AXES, size, strict=True):
        part = spark.range(n).select(F.col("id").cast("int").alias(a))
        out = part if out is None else out.crossJoin(part)
    return out
