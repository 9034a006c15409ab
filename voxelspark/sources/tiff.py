"""TIFF stacks: 8-bit slices, grey or colour, plain or compressed, read in parallel and written a file a slice."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspark.sources.sinks import write_files

#: Tags of the format that matter here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
#: The compressions by their numbers in a file (Deflate has two), and the weights of red, green and blue in grey.
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
DEFLATES, GREY = (8, 32946), (299, 587, 114)
_SIZES = {1: 1, 3: 2, 4: 4}
#: Fixed values of LZW: codes that clear the table and end the data, and the number of codes at which a writer clears it.
CLEAR, END, FULL = 256, 257, 4094


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; a code grows one entry before the table needs it."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, last, held, n = list(first), [], 9, None, 0, 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW data is damaged")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) == (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        last = entry
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    held, n, out = CLEAR, 9, bytearray()
    table, free, width, prefix = {}, 258, 9, -1

    def put(code: int, bits: int) -> None:
        nonlocal held, n
        held, n = held << bits | code, n + bits
        while n >= 8:
            n -= 8
            out.append(held >> n)
            held &= (1 << n) - 1

    for byte in data:
        if prefix < 0:
            prefix = byte
        elif (known := table.get(prefix << 8 | byte)) is not None:
            prefix = known
        else:
            put(prefix, width)
            table[prefix << 8 | byte] = free
            free += 1
            if free == FULL:
                put(CLEAR, width)
                table, free, width = {}, 258, 9
            elif free > (1 << width) - 1:
                width += 1
            prefix = byte
    if prefix >= 0:
        put(prefix, width)
        width += free + 1 > (1 << width) - 1
    put(END, width)
    if n:
        put(0, 8 - n)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs: a length below 128 is followed by so many bytes and one, one above by a byte that repeats."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def pack_bits(row: bytes) -> bytes:
    """One row: runs of three and more repeat, what is between them is copied."""
    if not row:
        return b""
    v = np.frombuffer(row, np.uint8)
    starts = np.flatnonzero(np.diff(v, prepend=np.int16(-1)) != 0)
    out, copied = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(copied), 128):
            part = copied[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        copied.clear()

    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(v)], strict=True):
        length = end - at
        if length < 3:
            copied.extend(row[at:end])
            continue
        flush()
        for k in range(0, length, 128):
            n = min(128, length - k)
            out.extend((257 - n, row[at]) if n > 1 else (0, row[at]))
    flush()
    return bytes(out)


def _tags(raw: bytes) -> dict[int, list[int]]:
    """The first directory of a file."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        entry = raw[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if (size := _SIZES.get(kind)) is None:
            continue
        place = entry[8:] if n * size <= 4 else raw[(start := struct.unpack(order + "I", entry[8:])[0]) : start + n * size]
        tags[tag] = list(struct.unpack(order + "BHI"[(1, 2, 4).index(size)] * n, place[: n * size])) if n * size <= len(place) else []
    return tags


def decode(raw: bytes) -> np.ndarray:
    """Pixels (rows, columns) of an 8-bit image in strips; colours become grey by their brightness, white-is-zero is turned."""
    tags = _tags(raw)
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h, samples, kind = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, 1)
    if set(tags.get(BITS, [1])) != {8} or samples not in (1, 3, 4) or one(PLANAR, 1) != 1 or one(PHOTOMETRIC, 1) not in (0, 1, 2):
        raise ValueError("only 8-bit grey or colour TIFF files, colours side by side, can be read")
    unpack = {1: bytes, 5: unpack_lzw, 32773: unpack_bits}.get(kind, zlib.decompress if kind in DEFLATES else None)
    if unpack is None or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"compression {kind} isn't known")
    rows, parts = one(ROWS, h), []
    for k, (o, c) in enumerate(zip(tags[OFFSETS], tags[COUNTS], strict=True)):
        n = min(rows, h - k * rows)
        strip = np.frombuffer(unpack(raw[o : o + c]), np.uint8)
        if len(strip) < n * w * samples:
            raise ValueError("a strip is too short")
        strip = strip[: n * w * samples].reshape(n, w, samples)
        parts.append(np.cumsum(strip, axis=1, dtype=np.uint8) if one(PREDICTOR, 1) == 2 else strip)
    pixels = np.concatenate(parts) if parts else np.zeros((h, w, samples), np.uint8)
    if pixels.shape[0] != h:
        raise ValueError("strips are missing")
    if samples > 1:
        return ((pixels[:, :, :3] * np.array(GREY)).sum(axis=2) // sum(GREY)).astype(np.uint8)
    return 255 - pixels[:, :, 0] if one(PHOTOMETRIC, 1) == 0 else pixels[:, :, 0]


def encode(pixels: np.ndarray, compression: str = "none", predictor: bool = False, strip_rows: int | None = None) -> bytes:
    """An 8-bit grey image in strips of ``strip_rows`` rows (all in one), each compressed by itself."""
    kind, v = COMPRESSIONS[compression], np.ascontiguousarray(pixels, np.uint8)
    h, w = v.shape
    if predictor:
        v = np.diff(v, axis=1, prepend=np.zeros((h, 1), np.uint8))
    rows = strip_rows or max(1, h)
    each = {"none": bytes, "lzw": pack_lzw, "deflate": zlib.compress}
    strips = [v[k : k + rows] for k in range(0, h, rows)]
    packed = [b"".join(pack_bits(line.tobytes()) for line in x) if compression == "packbits" else each[compression](x.tobytes()) for x in strips]
    tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, [0] * len(packed)), (SAMPLES, 3, [1]), (ROWS, 4, [rows]), (COUNTS, 4, [len(x) for x in packed])]
    tags += [(PREDICTOR, 3, [2])] if predictor else []
    # header, directory, the lists that don't fit their entries, the strips
    lists = 8 + 2 + 12 * len(tags) + 4
    data = lists + sum(4 * len(v) for _, k, v in tags if k == 4 and len(v) > 1)
    starts = (data + np.concatenate([[0], np.cumsum([len(x) for x in packed])])).astype(int).tolist()
    tags = [(t, k, starts[: len(packed)] if t == OFFSETS else v) for t, k, v in tags]
    out, far = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, k, values in tags:
        out += struct.pack("<HHI", tag, k, len(values))
        if k == 3:
            out += struct.pack("<HH", values[0], 0)
        elif len(values) == 1:
            out += struct.pack("<I", values[0])
        else:
            out += struct.pack("<I", lists + len(far))
            far += struct.pack(f"<{len(values)}I", *values)
    return out + struct.pack("<I", 0) + far + b"".join(packed)


def slice_files(spark: SparkSession, folder: str, suffix: str = "tif") -> DataFrame:
    """``z, path, content`` of a stack whose numbers must follow each other without gaps."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(folder)
    files = raw.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("int").alias("z"), "path", "content")
    low, high, n, kinds = files.agg(F.min("z"), F.max("z"), F.count(F.lit(1)), F.count_distinct("z")).first()
    if n and (high - low + 1 != n or kinds != n):
        raise ValueError(f"slices {low} to {high} aren't consecutive: there are {n}")
    return files


def _pixels(slices: DataFrame, flip: bool = False) -> DataFrame:
    """``x, y, z, intensity`` of every pixel of ``z, content`` that isn't 0; slices must be of one size."""

    def run(batches):
        for pdf in batches:
            for z, raw in zip(pdf["z"], pdf["content"], strict=True):
                pixels = decode(bytes(raw))
                pixels = pixels[::-1] if flip else pixels
                y, x = np.nonzero(pixels)
                yield pd.DataFrame({"x": x.astype("int32"), "y": y.astype("int32"), "z": np.full(len(x), z, "int32"), "intensity": pixels[y, x].astype("int32"), "width": pixels.shape[1], "height": pixels.shape[0]})

    out = slices.select("z", "content").mapInPandas(run, "x int, y int, z int, intensity int, width int, height int")
    if out.select("width", "height").distinct().count() > 1:
        raise ValueError("slices are of different sizes")
    return out.drop("width", "height")


def read_stack(spark: SparkSession, folder: str, suffix: str = "tif", flip: bool = False) -> DataFrame:
    """``x, y, z, intensity`` of the slices of a folder, z by their numbers; ``flip`` turns them upside down."""
    return _pixels(slice_files(spark, folder, suffix), flip)


def read_series(spark: SparkSession, folder: str, suffix: str = "tif") -> DataFrame:
    """``x, y, z, intensity`` of all slices below a folder, z by the order of their names without endings (a row a file is ordered)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    order = raw.select("path", (F.row_number().over(Window.orderBy(stem, "path")) - 1).alias("z"))
    return _pixels(raw.select("path", "content").join(F.broadcast(order), "path"))


def read_tile(spark: SparkSession, folder: str, tile_id: str, pair_id: str | None = None, listed: list[str] | None = None, flip: bool = False) -> DataFrame:
    """``x, y, z, intensity`` of a tile's slices in the order of their names, z from 0.

    They lie in folder/tile, or with ``pair_id`` in folder/tile/pair; with ``listed`` exactly the files of that list
    (the metadata's, relative to the folder) are read, and a missing one raises.
    """
    if listed is None:
        return read_series(spark, "/".join(p for p in (folder.rstrip("/"), tile_id, pair_id) if p))
    raw = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{f}" for f in listed])
    names = spark.createDataFrame([(f.rsplit("/", 1)[-1], k) for k, f in enumerate(sorted(listed))], "name string, z int")
    return _pixels(raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content").join(F.broadcast(names), "name"), flip)


def stack_to_store(spark: SparkSession, folder: str, path: str, volume_id: str, suffix: str = "tif") -> None:
    """A stack as Parquet voxels, by volume and sorted by z, so that scans of a slab read few row groups."""
    voxels = read_stack(spark, folder, suffix).withColumn("volume_id", F.lit(volume_id))
    voxels.repartitionByRange("z").sortWithinPartitions("z", "y", "x").write.mode("append").partitionBy("volume_id").parquet(path)


def write_stack(voxels: DataFrame, folder: str, width: int, height: int, first: int = 0, prefix: str = "full_", compression: str = "lzw", predictor: bool = False) -> None:
    """A TIFF file for each slice that holds a voxel, numbered from ``first``."""
    files = slices_as_bytes(voxels, width, height, compression, predictor)
    write_files(files.select(F.format_string(f"{prefix}%06d.tif", F.col("z") + first).alias("path"), "content"), folder)


def slices_as_bytes(voxels: DataFrame, width: int, height: int, compression: str = "none", predictor: bool = False) -> DataFrame:
    """``z, content``: each slice as a file's bytes (a slice is one image, so a task holds one at a time)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = np.zeros((height, width), np.uint8)
        pixels[pdf["y"], pdf["x"]] = pdf["intensity"]
        return pd.DataFrame({"z": [int(pdf["z"].iloc[0])], "content": [encode(pixels, compression, predictor)]})

    return voxels.groupBy("z").applyInPandas(run, "z int, content binary")
