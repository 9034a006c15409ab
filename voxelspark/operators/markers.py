"""Marker files, marker lists of tiles and views, and their merging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspark.functions.numbering import numbered as by_order
from voxelspark.functions.storage import cut
from voxelspark.operators.spatial import AXES, components, distance_join

SUBSTACK = r"\(([^)]*)\)$"


def parse_comments(df: DataFrame) -> DataFrame:
    """``mass, volume, hue, evr, radius`` out of a tab-separated comment; what is missing is null."""
    item = lambda k: F.element_at(F.split("comment", "\t"), k + 1)
    number = lambda key: F.regexp_extract("comment", rf"(?:^|\s){key}=\s*(\S+)", 1).try_cast("double")
    size = F.size(F.split("comment", "\t"))
    return df.select(
        "*",
        number("m").alias("mass"),
        number("v").alias("volume"),
        number("hue").alias("hue"),
        F.when(size > 5, F.transform(F.split(item(5), ":"), lambda x: x.try_cast("double"))).alias("evr"),
        F.when(size > 6, item(6).try_cast("double")).alias("radius"),
    )


def read_markers(spark: SparkSession, path: str, from_annotator: bool = False) -> DataFrame:
    """Marker CSV with any of its header spellings (``x``, ``#x``, ``##x``, spaces around); empty names of annotators get a number."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=False)
    df = raw.toDF(*[c.strip().lstrip("#") for c in raw.columns])
    df = df.withColumns({a: F.col(a).cast("double") for a in AXES})
    if from_annotator:
        placed = by_order(df.withColumn("_row", F.monotonically_increasing_id()), F.col("_row"), name="_place").drop("_row")
        named = F.when(F.coalesce("name", F.lit("")) == "", F.format_string("landmark %d", F.col("_place") + 1)).otherwise(F.col("name"))
        return placed.withColumn("name", named).drop("_place")
    return parse_comments(df)


def format_markers(df: DataFrame, floating_point: bool = False) -> DataFrame:
    """Rows as a marker file has them: 1-based (rounded unless floating point), attributes in the comment."""
    shift = lambda a: (F.col(a) + 1) if floating_point else F.round(F.col(a) + 1).cast("long")
    comment = F.concat_ws("\t", F.format_string("m=%.2f", "mass"), F.format_string("v=%.2f", "volume"), F.format_string("hue=%.2f", "hue"))
    return df.select(*[shift(a).alias(a) for a in AXES], F.lit(0).alias("radius"), F.lit(1).alias("shape"), "name", comment.alias("comment"))


def write_markers(df: DataFrame, path: str, floating_point: bool = False) -> None:
    """Marker CSV with the ``##x`` header; nothing is written for an empty list."""
    if not df.isEmpty():
        out = format_markers(df, floating_point)
        out.withColumnRenamed("x", "##x").write.csv(path, header=True)


def read_apo(spark: SparkSession, path: str) -> DataFrame:
    """A point list as it stands: every column by its header's name, spaces around dropped, coordinates as numbers."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = raw.toDF(*[c.strip().lstrip("#") for c in raw.columns])
    return df.withColumns({a: F.col(a).cast("double") for a in AXES if a in df.columns})


def read_whole_volume(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z, name, mass, volume, radius, hue`` of a marker file of the whole volume: 1-based, cut to whole numbers; the comment lists values in this order."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    part = lines.select(F.split(F.trim("value"), ",").alias("p"))
    items = F.split(F.col("p")[6], "\t")
    value = lambda k: F.element_at(F.split(F.get(items, F.lit(k)), "="), 2).cast("double")
    at = [(F.col("p")[k].cast("double").cast("int") - 1).alias(a) for k, a in enumerate(AXES)]
    return part.select(*at, F.col("p")[5].alias("name"), *[value(k).alias(n) for k, n in enumerate(("mass", "volume", "radius", "hue"))])


def load(spark: SparkSession, path: str, from_annotator: bool = False, size: tuple[int, int, int] | None = None) -> DataFrame:
    """Markers by the file's ending, 0-based; with ``size`` a marker outside the volume raises when it is met."""
    if path.endswith(".marker"):
        df = read_markers(spark, path, from_annotator).withColumns({a: F.col(a) - 1 for a in AXES})
    elif path.endswith(".apo"):
        df = read_apo(spark, path)
    else:
        raise ValueError(f"neither a .marker nor an .apo file: {path}")
    if size is None:
        return df
    for a, w in zip(AXES, size, strict=True):
        wrong = F.raise_error(F.concat(F.lit(f"marker outside the volume: {a} = "), F.col(a).cast("string"))).cast("double")
        df = df.withColumn(a, F.when(F.col(a).between(0, w - 1), F.col(a)).otherwise(wrong))
    return df


def within_volume(df: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Markers at 0 to width - 1 on every axis."""
    for a, w in zip(AXES, size, strict=True):
        df = df.where(F.col(a).between(0, w - 1))
    return df


def without_landmarks(df: DataFrame, name: str = "name") -> DataFrame:
    """Markers that no annotator's default name marks as a landmark; nameless ones stay."""
    return df.where(~F.coalesce(F.col(name).contains("(landmark"), F.lit(False)))


def reject_far(df: DataFrame, bound: float | None) -> DataFrame:
    """With ``rejected``: whether a marker's distance from its manifold reaches the bound (without a bound none is; without a distance a bound raises)."""
    if bound is None:
        return df.withColumn("rejected", F.lit(False))
    if "distance" not in df.columns:
        raise ValueError("the markers have no column of distances")
    return df.withColumn("rejected", F.coalesce(F.col("distance") >= bound, F.lit(False)))


def merge_in_order(markers: DataFrame, radius: float) -> DataFrame:
    """Markers of overlapping tiles merged tile by tile in the order of their names.

    A marker looks at the nearest of those that the tiles before its own left (ties: the smaller name); closer than
    ``radius`` the one less deep inside its tile goes, on a tie the earlier one.

    What a marker meets depends on the earlier markers within the radius and on those that may have taken one of them
    away before. A wave decides all markers for which both are decided, so there are as many waves as tiles follow each
    other in one place, and no group is ever walked through as a whole.
    """
    columns = markers.select(F.xxhash64("tile_id", "id").alias("key"), "id", "tile_id", *AXES, "depth")
    pairs = distance_join(columns, columns, radius).where("a_tile_id > b_tile_id")
    pairs = cut(pairs.select(F.col("a_key").alias("k"), F.col("b_key").alias("n"), "d", F.col("a_tile_id").alias("tile"), F.col("b_tile_id").alias("n_tile"), F.col("b_id").alias("n_id"), F.col("a_depth").alias("depth"), F.col("b_depth").alias("n_depth")))
    open_ = cut(pairs.select("k", "tile").distinct())
    rivals = pairs.select(F.col("k").alias("on"), "n", F.col("tile").alias("on_tile"))
    through = pairs.select("k", "n", "tile").join(rivals, "n").where("on_tile < tile").select("k", "on")
    waits = cut(pairs.select("k", F.col("n").alias("on")).unionByName(through).join(open_.select(F.col("k").alias("on")), "on", "left_semi").distinct())
    done = None
    while not open_.isEmpty():
        held = waits.join(open_.select(F.col("k").alias("on")), "on", "left_semi").select("k")
        ready = cut(open_.join(held, "k", "left_anti"))
        there = pairs.join(ready.select("k"), "k")
        if done is not None:
            # a marker is still there unless an earlier tile, or itself, took it away
            gone = done.select(F.col("loses").alias("n"), F.col("tile").alias("by"))
            there = there.alias("t").join(gone.alias("g"), (F.col("t.n") == F.col("g.n")) & (F.col("g.by") < F.col("t.tile")), "left_anti")
        near = there.groupBy("k", "tile", "depth").agg(F.min(F.struct("d", "n_tile", "n_id", "n", "n_depth")).alias("m"))
        settled = near.select("k", "tile", F.when(F.col("depth") < F.col("m.n_depth"), F.col("k")).otherwise(F.col("m.n")).alias("loses"))
        done = cut(settled if done is None else done.unionByName(settled))
        open_ = cut(open_.join(ready.select("k"), "k", "left_anti"))
    if done is None:
        return markers
    lost = done.select(F.col("loses").alias("_lost")).distinct()
    return markers.withColumn("_key", F.xxhash64("tile_id", "id")).join(lost, F.col("_key") == F.col("_lost"), "left_anti").drop("_key")


def merge_tiles(markers: DataFrame, radius: float) -> DataFrame:
    """Markers of overlapping tiles without near duplicates.

    ``markers(id, tile_id, x, y, z, depth)`` are global with ``depth`` their margin depth in their own tile. Of two
    markers of different tiles closer than ``radius`` the one deeper inside its tile stays; on a tie that of the later
    tile, then the larger id. Chains are judged on the input, so the result doesn't depend on any order of visits.
    """
    columns = markers.select("id", "tile_id", *AXES, "depth")
    pairs = distance_join(columns, columns, radius).where("a_tile_id <> b_tile_id")
    beaten = pairs.where(F.struct("b_depth", "b_tile_id", "b_id") > F.struct("a_depth", "a_tile_id", "a_id")).select(F.col("a_id").alias("id"), F.col("a_tile_id").alias("tile_id")).distinct()
    return markers.join(beaten, ["id", "tile_id"], "left_anti")


def with_depth(markers: DataFrame, margin: float) -> DataFrame:
    """Margin depth of each marker within its tile (columns ``x0`` to ``z1``)."""
    faces = [d for a in AXES for d in (F.col(a) - F.col(f"{a}0") - margin, F.col(f"{a}1") - margin - F.col(a))]
    return markers.withColumn("depth", F.least(*faces))


def fuse(first: DataFrame, second: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched markers of two views averaged, unmatched ones of either kept: ``a_id, b_id, x, y, z, origin``."""
    a = first.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a{c}") for c in AXES])
    b = second.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b{c}") for c in AXES])
    both = a.join(matches.select("a_id", "b_id"), "a_id", "left").join(b, "b_id", "full")
    origin = F.when(F.col("ax").isNull(), "second").when(F.col("bx").isNull(), "first").otherwise("both")
    return both.select("a_id", "b_id", *[F.coalesce((F.col(f"a{c}") + F.col(f"b{c}")) / 2, f"a{c}", f"b{c}").alias(c) for c in AXES], origin.alias("origin"))


def visible_pairs(views: DataFrame, view_ids: tuple[str, str, str, str], least: int = 30) -> DataFrame:
    """``tile_id, n_seen, pairs``: which pairs of four views round the tile to merge, by who sees enough of it.

    A pair is of one of the first and third view with one of the second and fourth. All four seen: all pairs. Three:
    those whose first view sees. Two that face each other: all; two neighbours: theirs. One: the pairs it is in.
    """
    see = [F.coalesce(F.max(F.when(F.col("view_id") == v, F.col("t1") >= least)), F.lit(False)).alias(f"s{k}") for k, v in enumerate(view_ids)]
    by = views.groupBy("tile_id").agg(*see).withColumn("n_seen", sum(F.col(f"s{k}").cast("int") for k in range(4)))
    facing = (F.col("s0") & F.col("s2")) | (F.col("s1") & F.col("s3"))
    keep = []
    for a in (0, 2):
        for b in (1, 3):
            sa, sb = F.col(f"s{a}"), F.col(f"s{b}")
            test = F.when(F.col("n_seen") == 4, True).when(F.col("n_seen") == 3, sa).when(F.col("n_seen") == 2, facing | (sa & sb)).when(F.col("n_seen") == 1, sa | sb).otherwise(False)
            keep.append(F.when(test, F.lit(f"{view_ids[a]}_{view_ids[b]}")))
    return by.select("tile_id", "n_seen", F.concat_ws(",", *keep).alias("pairs"))


def merge_views(found: dict[tuple[str, str], DataFrame], view_ids: tuple[str, str, str, str], match: Callable[[DataFrame, DataFrame], DataFrame], turn: Callable[[DataFrame], DataFrame], size: tuple[int, int, int]) -> DataFrame | None:
    """``x, y, z`` of one tile from its view pairs' markers (``id, x, y, z``).

    Pairs that share their first view lie in one frame and are fused; those of the third view are then turned into the
    first one's frame and fused with it. What falls outside the tile is dropped. No pair: nothing.
    """
    def together(frames: list[DataFrame]) -> DataFrame | None:
        out = None
        for f in frames:
            out = f.select("id", *AXES) if out is None else _renumbered(fuse(out, f, match(out, f)))
        return out

    first = together([f for (a, _), f in sorted(found.items()) if a == view_ids[0]])
    third = together([f for (a, _), f in sorted(found.items()) if a == view_ids[2]])
    # alone, the third view stays in its own frame
    whole = together([f for f in (first, turn(third) if third is not None and first is not None else third) if f is not None])
    if whole is None:
        return None
    return within_volume(whole, size).select(*AXES)


def _renumbered(fused: DataFrame) -> DataFrame:
    """Fused markers with ids of their own: even for the first view's, odd for those only the second has."""
    return fused.select(F.coalesce(F.col("a_id") * 2, F.col("b_id") * 2 + 1).alias("id"), *AXES)


def substack_of(name: str = "name"):
    return F.regexp_extract(name, SUBSTACK, 1)


def best_per_name(df: DataFrame) -> DataFrame:
    """The row with the smallest distance of each name (ties: the smaller id)."""
    first = F.row_number().over(Window.partitionBy("name").orderBy("distance", "id"))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")



def numbered(df: DataFrame, tiles: DataFrame, label: str = "MS_center", turn: float = 0.31) -> DataFrame:
    """``df`` with ``name`` (label and number of the marker within its tile, by id) and ``hue``, which turns by ``turn`` from tile to tile."""
    # a row a tile
    hues = tiles.select("tile_id", ((F.row_number().over(Window.orderBy("tile_id")) - 1) * turn % 1.0).alias("hue"))
    n = F.row_number().over(Window.partitionBy("tile_id").orderBy("id")) - 1
    return df.withColumn("name", F.concat(F.lit(f"{label} "), n.cast("string"))).join(F.broadcast(hues), "tile_id")


def dealt(seeds: DataFrame, jobs: int) -> DataFrame:
    """``seeds`` with ``job``: dealt in turn, the largest id first."""
    return by_order(seeds, F.col("id").desc(), name="job").withColumn("job", (F.col("job") % jobs).cast("int"))
