"""Tiles of a volume with overlapping margins, and what lies in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def tile_grid(spark: SparkSession, size: tuple[int, int, int], counts: tuple[int, int, int], margin: int) -> DataFrame:
    """``tile_id, x0, x1, y0, y1, z0, z1``: per axis steps of ``round((size - margin) / n)``, each tile a margin longer (ends exclusive)."""
    out = None
    for axis, whole, n in zip(AXES, size, counts, strict=True):
        step = int((whole - margin) / n + 0.5)
        part = spark.range(n).select(
            F.col("id").cast("int").alias(f"i{axis}"), (F.col("id") * step).cast("int").alias(f"{axis}0"), F.least(F.lit(whole), F.col("id") * step + step + margin).cast("int").alias(f"{axis}1")
        )
        out = part if out is None else out.crossJoin(part)
    return out.select(F.format_string("%02d%02d%02d", "ix", "iy", "iz").alias("tile_id"), *[f"{a}{e}" for a in AXES for e in "01"])


def in_tile(dims: dict[str, int] | None = None) -> Column:
    """Half-open box test of a point against a tile's columns."""
    test = F.lit(True)
    for a in AXES:
        test = test & (F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1"))
    return test


def assign_tiles(points: DataFrame, size: tuple[int, int, int], counts: tuple[int, int, int], margin: int) -> DataFrame:
    """Every (point, tile) with the point in the tile's half-open box: tile numbers are computed, nothing is joined.

    On an axis tile ``i`` covers ``[i*step, min(size, (i+1)*step + margin))``, so a coordinate lies in tiles
    ``floor((c - margin) / step)`` to ``floor(c / step)``, within the grid.
    """
    out = points
    for axis, whole, n in zip(AXES, size, counts, strict=True):
        step = int((whole - margin) / n + 0.5)
        c = F.col(axis)
        high = F.least(F.floor(c / step), F.lit(n - 1)).cast("int")
        low = F.greatest(F.floor((c - margin) / step), F.lit(0)).cast("int")
        # the lowest candidate ends where its margin does
        low = F.when(c >= F.least(F.lit(whole), (low + 1) * step + margin), low + 1).otherwise(low)
        some = F.when((c >= 0) & (c < whole) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(f"_i{axis}", F.explode(some))
    return out.withColumn("tile_id", F.format_string("%02d%02d%02d", "_ix", "_iy", "_iz")).drop("_ix", "_iy", "_iz")


def margin_depth(size: tuple[float, float, float], margin: float) -> Column:
    """Signed distance to the nearest of the six faces of the inner box; negative outside."""
    faces = [d for a, w in zip(AXES, size, strict=True) for d in (F.col(a) - margin, F.lit(float(w)) - margin - F.col(a))]
    return F.least(*faces)


def inside(size: tuple[float, float, float], margin: float) -> Column:
    """Whether a point lies in the inner box, faces included."""
    test = F.lit(True)
    for a, w in zip(AXES, size, strict=True):
        test = test & F.col(a).between(margin, w - margin)
    return test


def box_scan(voxels: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Hyper-slab: rows within the half-open ranges (the predicate reaches the Parquet scan)."""
    for a, (low, high) in box.items():
        voxels = voxels.where((F.col(a) >= low) & (F.col(a) < high))
    return voxels


def padded_scan(voxels: DataFrame, box: dict[str, tuple[int, int]], halo: int) -> DataFrame:
    """Hyper-slab with a halo; cells without a voxel, also those outside the volume, hold 0."""
    grid = None
    for a, (low, high) in box.items():
        part = voxels.sparkSession.range(low - halo, high + halo).select(F.col("id").cast("int").alias(a))
        grid = part if grid is None else grid.crossJoin(part)
    near = box_scan(voxels, {a: (low - halo, high + halo) for a, (low, high) in box.items()})
    return grid.join(near, list(box), "left").fillna(0, ["intensity"])
