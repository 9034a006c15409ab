"""Patch data sets, pluggable predictors, and the deconvolution of a volume with one."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.numbering import numbered
from voxelspark.functions.storage import cut
from voxelspark.operators import blocks, kernels
from voxelspark.operators.tiling import margin_depth

AXES = ("x", "y", "z")
#: A predictor takes and gives matrices with a row a patch.
Predictor = Callable[[np.ndarray], np.ndarray]


def standardizer(patches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each position (a row a position: bounded by the patch); constant positions get 1."""
    rows = patches.select(F.posexplode("patch").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("pos").collect()
    return np.array([r.m for r in rows]), np.array([r.s or 1.0 for r in rows])


def standardized(values: DataFrame, key: str, value: str) -> DataFrame:
    """``values`` (whole numbers) with ``value`` as it stands in the deviations of its ``key``; null where all values of a key are equal.

    The variance comes from exact sums: that of equal values is 0 however many tasks share them, which deviations that are
    put together task by task don't give.
    """
    v, wide = F.col(value), lambda c: F.sum(c).cast("decimal(38,0)")
    sums = values.groupBy(F.col(key).alias("_key")).agg(F.count(v).cast("decimal(19,0)").alias("n"), wide(v.cast("long")).alias("s"), wide(v.cast("long") * v.cast("long")).alias("q"))
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")
    stats = sums.select("_key", (F.col("s").cast("double") / F.col("n").cast("double")).alias("_m"), F.nullif(F.sqrt(spread) / F.col("n").cast("double"), F.lit(0.0)).alias("_s"))
    placed = values.join(stats, F.col(key).eqNullSafe(F.col("_key")))
    return placed.select(*[c for c in values.columns if c != value], ((v - F.col("_m")) / F.col("_s")).alias("value"))


def predict(patches: DataFrame, predictor: Predictor, mean: np.ndarray | None = None, std: np.ndarray | None = None) -> DataFrame:
    """``id, patch`` predicted batch by batch (every row, the last ones of a partition too)."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["patch"]).astype(float)
                x = x if mean is None else (x - mean) / std
                yield pd.DataFrame({"id": pdf["id"], "patch": list(predictor(x).astype(float))})

    return patches.select("id", "patch").mapInPandas(run, "id long, patch array<double>")


def local_standardizer(patches: DataFrame, stored: tuple[np.ndarray, np.ndarray], bright: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each position over the patches whose mean is above ``bright`` (of 255, values 0 to 1).

    With fewer such patches than all of them divided by a patch's length the stored figures hold.
    """
    mean = F.aggregate("patch", F.lit(0.0), lambda a, v: a + v) / F.size("patch")
    marked = patches.select("patch", (mean * 255 > bright).alias("good"))
    n, good, length = marked.agg(F.count(F.lit(1)), F.count_if("good"), F.max(F.size("patch"))).first()
    if not n or good < n / length:
        return stored
    rows = marked.where("good").select(F.posexplode("patch").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("pos").collect()
    return np.array([r.m for r in rows]), np.array([r.s for r in rows])


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def label_counts(examples: DataFrame) -> DataFrame:
    """``positives, negatives, rejected, ratio`` of examples with ``label`` (1 or 0) and ``rejected``; without negatives no ratio."""
    p, n = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return examples.agg(p.alias("positives"), n.alias("negatives"), F.count_if("rejected").alias("rejected"), F.round(F.try_divide(p, n), 6).alias("ratio"))


def site_grid(box: dict[str, tuple[int, int]], stride: int, spark) -> DataFrame:
    """``id, x, y, z``: patch centres every ``stride`` voxels."""
    out = None
    for a, (low, high) in box.items():
        part = spark.range(low, high, stride).select(F.col("id").cast("int").alias(a))
        out = part if out is None else out.crossJoin(part)
    key = F.col("x").cast("long") * 1_000_000_007 + F.col("y").cast("long") * 100_003 + F.col("z").cast("long")
    return out.select(key.alias("id"), *AXES)


def deconvolve(voxels: DataFrame, box: dict[str, tuple[int, int]], size: int, stride: int, predictor: Predictor, mean: np.ndarray | None = None, std: np.ndarray | None = None) -> DataFrame:
    """``x, y, z, intensity``: patches of the scaled volume predicted, laid over each other, normalised and smoothed.

    Sums are divided by their coverage, shifted only if negative, scaled only if above 1, smoothed by a Gaussian of a third
    of the stride, cut to the box and truncated to 8 bits.
    """
    mean_, std_ = (0.0, 1.0) if mean is None else (mean, std)
    volume = blocks.store(blocks.pack(voxels.select(*AXES, (F.col("intensity") / 255.0).alias("intensity"))))
    level = cut(blocks.overlaid(volume, box, size, stride, lambda x: predictor((x - mean_) / std_)))
    low, high = level.agg(F.least(F.min("low"), F.lit(0.0)), F.max("high")).first()
    unit = blocks.store(blocks.scaled(level, lambda v: (v - low) / max(high - low, 1.0)))
    sigma = stride / 3
    reach = int(np.ceil(2 * sigma))
    offsets = [(a, b, c, np.exp(-(a * a + b * b + c * c) / (2 * sigma * sigma))) for a, b, c, _ in kernels.cube(reach)]
    whole = sum(w for *_, w in offsets)
    smooth = blocks.convolve(unit, [(a, b, c, float(w / whole)) for a, b, c, w in offsets])
    for a, (low_, high_) in box.items():
        smooth = smooth.where((F.col(a) >= low_) & (F.col(a) < high_))
    return smooth.select(*AXES, F.least(F.lit(255), F.floor(F.round(F.col("local_mass") * 255, 6))).cast("int").alias("intensity"))


def balanced(examples: DataFrame, label: str = "label", seed: int = 0) -> DataFrame:
    """As many negatives as positives: those whose seeded hash of the id is smallest."""
    marked = cut(examples.withColumn("_hash", F.xxhash64("id", F.lit(seed))))
    negatives = marked.where(F.col(label) == 0)
    # places, not a sort: no task holds all the negatives that are taken
    placed = numbered(negatives.withColumn("_row", F.monotonically_increasing_id()), F.col("_hash"), F.col("id"), F.col("_row"), name="_place")
    few = placed.where(F.col("_place") < marked.where(F.col(label) == 1).count())
    return marked.where(F.col(label) == 1).drop("_hash").unionByName(few.drop("_hash", "_row", "_place"))


def view_dropout(examples: DataFrame, rate: float, features: str = "features", seed: int = 0) -> DataFrame:
    """Two-view rows of which a seeded share loses its left or its right half (set to zero)."""
    roll = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    half = F.size(features) / 2
    left = F.transform(features, lambda v, i: F.when(i < half, F.lit(0.0)).otherwise(v))
    right = F.transform(features, lambda v, i: F.when(i >= half, F.lit(0.0)).otherwise(v))
    return examples.withColumn(features, F.when(roll < rate / 2, left).when(roll < rate, right).otherwise(F.col(features)))


def halves(examples: DataFrame, features: str = "features") -> DataFrame:
    """Two-view features as two columns."""
    n = (F.size(features) / 2).cast("int")
    return examples.withColumn("first_view", F.slice(features, F.lit(1), n)).withColumn("second_view", F.slice(features, n + 1, n))


def masked(examples: DataFrame, category: str, features: str = "features") -> DataFrame:
    """Features times a row's category."""
    return examples.withColumn(features, F.transform(features, lambda v: v * F.col(category)))


def gaussian_targets(markers: DataFrame, size: tuple[int, int, int], margin: float, sigma: float = 1.0, truncate: float = 1.5) -> DataFrame:
    """``x, y, z, target``: the volume with 1 at each marker's voxel, smoothed by a Gaussian and divided by its greatest value.

    Only markers deeper than the margin count, two at one voxel as one. The Gaussian ends at ``int(truncate * sigma + 0.5)``
    cells along each axis; cells it doesn't reach have no row, outside the volume there are none.
    """
    reach = int(truncate * sigma + 0.5)
    at = markers.where(margin_depth(size, margin) > 0).select(*[F.rint(a).cast("int").alias(a) for a in AXES]).distinct()
    offsets = [(a, b, c, math.exp(-(a * a + b * b + c * c) / (2 * sigma * sigma))) for a, b, c, _ in kernels.cube(reach)]
    sums = kernels.shifted(at, offsets).groupBy(*AXES).agg(F.sum("w").alias("w"))
    for a, w in zip(AXES, size, strict=True):
        sums = sums.where(F.col(a).between(0, w - 1))
    sums = cut(sums)
    return sums.crossJoin(F.broadcast(sums.agg(F.max("w").alias("most")))).select(*AXES, (F.col("w") / F.col("most")).alias("target"))


def shrunk_sigma(markers: DataFrame, sigma: float, radius: float, skip_nearest: bool = False) -> DataFrame:
    """``id, sigma``: a target's width, a third of the distance to its nearest other marker where that is less.

    With ``skip_nearest`` the nearest other marker is passed over.
    """
    from voxelspark.operators.spatial import distance_join

    rows = markers.select("id", *AXES)
    near = distance_join(rows, rows, radius).where("a_id <> b_id").groupBy("a_id").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    pick = F.get("ds", F.lit(1 if skip_nearest else 0))
    return markers.join(near, markers["id"] == near["a_id"], "left").select("id", F.least(F.lit(sigma), F.coalesce(pick / 3, F.lit(sigma))).alias("sigma"))


def joint_targets(markers: DataFrame, sigmas: DataFrame, size: int) -> DataFrame:
    """``x, y, z, target``: Gaussians of each marker's own width, combined by their maximum."""
    at = markers.join(sigmas, "id").select(*[F.rint(a).cast("int").alias(a) for a in AXES], "sigma")
    moved = at.withColumn("o", F.explode(kernels._offsets(kernels.cube(size))))
    d2 = sum(F.col(f"o.d{a}") * F.col(f"o.d{a}") for a in AXES)
    return moved.select(*[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], F.exp(-d2 / (2 * F.col("sigma") * F.col("sigma"))).alias("w")).groupBy(*AXES).agg(F.max("w").alias("target"))
