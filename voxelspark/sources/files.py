"""The small text formats around volumes: tile metadata, transforms, landmarks, thresholds, evaluation logs."""

from __future__ import annotations

import io
import json
import pickle
import plistlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of metadata files in the order in which they are looked for.
NAMES = ("info.json", "info.plist.pkl", "info.plist")


class _Plain(pickle.Unpickler):
    """Reads numbers, texts, lists and dicts; a file that asks for anything else is refused."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} in tile metadata")


def parse_tiles(raw: bytes) -> dict:
    """Tile metadata as JSON, else as a plain pickle, else as a property list; anything else raises."""
    for parse in (json.loads, lambda x: _Plain(io.BytesIO(x), encoding="utf-8").load(), plistlib.loads):
        try:
            found = parse(raw)
        except Exception:  # noqa: BLE001, S112 - each format fails in its own ways; the next one is tried
            continue
        if isinstance(found, dict) and "SubStacks" in found:
            return found
    raise ValueError("tile metadata is neither JSON nor a plain pickle nor a property list")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """``tile_id, x0, y0, z0, width, height, depth, margin, files`` of a metadata file (a row a tile); an unreadable one raises.

    ``path`` is the file, or a folder that holds one of the usual names.
    """
    # of a folder only the names that metadata has, or those that write_tiles gives: its slices may be large
    named = path.rstrip("/").rsplit("/", 1)[-1]
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join((*NAMES, "part-*.txt")) + "}" if folder else named).load(path)
    by = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in raw.select("path", "content").collect()}
    if not by:
        raise ValueError(f"no tile metadata in {path}")
    raw = next((by[n] for n in NAMES if n in by), None) or by[min(by)]
    info = parse_tiles(raw)
    rows = [(k, *[None if t.get(f) is None else int(t[f]) for f in ("X0", "Y0", "Z0", "Width", "Height", "Depth")], [str(x) for x in t["Files"]] if t.get("Files") is not None else None, int(info["Margin"]) if "Margin" in info else None) for k, t in info["SubStacks"].items()]
    return spark.createDataFrame(rows, "tile_id string, x0 int, y0 int, z0 int, width int, height int, depth int, files array<string>, margin int")


def write_tiles(tiles: DataFrame, whole: dict[str, int], path: str) -> None:
    """The metadata of a tile grid as one JSON document (a row a tile: small)."""
    t = tiles.select("tile_id", F.struct(*[F.col(b).alias(a) for a, b in {"X0": "x0", "Y0": "y0", "Z0": "z0", "Width": "width", "Height": "height", "Depth": "depth", "Files": "files"}.items()]).alias("t"))
    one = t.agg(F.map_from_entries(F.collect_list(F.struct("tile_id", "t"))).alias("SubStacks")).select(*[F.lit(v).alias(k) for k, v in whole.items()], "SubStacks")
    one.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """``id, r (9 doubles, by rows), t (3 doubles)``: a line is an id, twelve numbers and anything."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    lines = spark.read.text(path).where(F.trim("value") != "")
    rest = F.regexp_replace("value", r"^[^,]*,", "")
    found = lines.select(F.trim(F.split("value", ",")[0]).alias("id"), F.transform(F.regexp_extract_all(rest, F.lit(f"({number})")), lambda v: v.cast("double")).alias("n"))
    return found.where(F.size("n") >= 12).select("id", F.slice("n", 1, 9).alias("r"), F.slice("n", 10, 3).alias("t"))


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """``id, x, y, z`` in file order; lines that start with # are left out."""
    raw = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    parts = F.split("value", r"\s*,\s*")
    rows = raw.select(F.monotonically_increasing_id().alias("id"), *[parts[k].cast("double").alias(a) for k, a in enumerate("xyz")])
    return rows


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """``tile_id, view_id, t0, t1`` from files tile/view that hold two numbers."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.input_file_name().alias("f"))
    place, parts = F.split("f", "/"), F.split("value", ",")
    return raw.select(F.element_at(place, -2).alias("tile_id"), F.element_at(place, -1).alias("view_id"), parts[0].cast("int").alias("t0"), parts[1].cast("int").alias("t1"))


def read_eval_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Evaluation logs of any number of runs, headers repeated or not; the tile id stays text."""
    schema = "substack string, method string, parameter string, precision double, recall double, F1 double, TP long, FP long, FN long, n_true long, n_pred long"
    return spark.read.schema(schema).csv(paths, header=True, comment="#").where("substack <> 'substack'").withColumn("run", F.input_file_name())


def parse_registration(text: str) -> dict[str, list[float]]:
    """Registration parameters: numbers in a fixed order, counts by the number of levels."""
    values = [float(v) for v in text.split()]
    at = 0

    def take(n: int) -> list[float]:
        nonlocal at
        if at + n > len(values):
            raise ValueError("registration parameters end early")
        at += n
        return values[at - n : at]

    out = {"permute": take(3), "flip": take(3), "levels": take(1)}
    levels = int(out["levels"][0])
    out |= {"fixed_shrink": take(3), "moving_shrink": take(3), "iterations": take(levels), "rates": take(levels)}
    return out | {"translation_scale": take(1), "samples": take(1), "metric": take(1)}
