"""A volume as dense blocks, and the operators that look around each cell.

``pack`` makes one row of every ``SIDE`` cubed cells that hold a voxel: their values as one array of bytes and one bit a
cell for what is present. ``store`` writes such rows as a table bucketed by block, so that what comes later finds a block
where it lies. An operator then needs only the faces of the neighbouring blocks: ``around`` cuts them off, sends them
(that is all that is shuffled: about ``6 h / SIDE`` of the volume for a halo of ``h``), and runs a numpy function once a
block on its cells with their halo. A block bounds what a task holds, however many voxels, and a lost task costs the
blocks it had.

Cells without a voxel, also those outside the volume, are 0, and have no row in a result unless it says so.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.storage import shared_path

AXES = ("x", "y", "z")
KEY = ("bx", "by", "bz")
#: Cells of a block along each axis; a block of doubles is 256 KB.
SIDE = 32
BLOCK = "bx int, by int, bz int, cells binary, present binary"
_PART = "bx int, by int, bz int, dx int, dy int, dz int, cells binary"
DIRECTIONS = tuple(d for d in itertools.product((-1, 0, 1), repeat=3) if d != (0, 0, 0))
#: A function of a block with its halo and of its origin: named arrays of the block's own shape.
Stencil = Callable[[np.ndarray, tuple[int, int, int]], dict[str, np.ndarray]]


def pack(voxels: DataFrame, side: int = SIDE, value: str = "intensity") -> DataFrame:
    """Blocks of ``voxels(x, y, z, value)``, axes in the order x, y, z, values as doubles; of voxels at one place the last of some order counts."""
    at = [F.floor(F.col(a) / side).cast("int").alias(b) for a, b in zip(AXES, KEY, strict=True)]
    place = sum(F.pmod(F.col(a).cast("int"), F.lit(side)) * side ** (2 - i) for i, a in enumerate(AXES))

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        values, present = np.zeros(side**3), np.zeros(side**3, bool)
        where = np.asarray(cells["place"])
        values[where], present[where] = np.asarray(cells["value"]), True
        return _table([k.as_py() for k in key], cells=values.tobytes(), present=np.packbits(present).tobytes())

    return voxels.select(*at, place.cast("int").alias("place"), F.col(value).cast("double").alias("value")).groupBy(*KEY).applyInArrow(run, BLOCK)


def _table(key: Iterable[int], **columns: bytes) -> pa.Table:
    data = {k: pa.array([v], pa.int32()) for k, v in zip(KEY, key, strict=True)} | {k: pa.array([v], pa.binary()) for k, v in columns.items()}
    return pa.table(data)


def store(blocks: DataFrame, name: str | None = None, buckets: int | None = None) -> DataFrame:
    """``blocks`` written as a table bucketed and sorted by block: in the warehouse under ``name``, else in the shared folder for this session."""
    spark = blocks.sparkSession
    writer = blocks.write.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY).sortBy(*KEY)
    if name is None:
        name = f"blocks_{uuid.uuid4().hex}"
        writer = writer.option("path", shared_path(spark, "blocks"))
    writer.saveAsTable(name)
    return spark.table(name)


def _reach(d: int, h: int, side: int) -> slice:
    """Of a block's cells on one axis those that a neighbour in direction ``d`` sees."""
    return slice(side - h, side) if d > 0 else slice(0, h) if d < 0 else slice(0, side)


def _place(d: int, h: int, side: int) -> slice:
    """Where in a block with its halo the cells of the neighbour in direction ``d`` lie."""
    return slice(h + side, h + side + h) if d > 0 else slice(0, h) if d < 0 else slice(h, h + side)


def faces(blocks: DataFrame, h: int, side: int = SIDE) -> DataFrame:
    """``bx, by, bz, dx, dy, dz, cells``: for each neighbour of a block what that one's halo takes from it, and in which direction it lies from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in range(3)]
            for i, key in enumerate(zip(*keys, strict=True)):
                v = np.frombuffer(batch.column(3)[i].as_py()).reshape(side, side, side)
                out = {k: [] for k in (*KEY, "dx", "dy", "dz", "cells")}
                for d in DIRECTIONS:
                    cut = v[tuple(_reach(c, h, side) for c in d)]
                    if cut.any():
                        for name, b, c in zip((*KEY,), key, d, strict=True):
                            out[name].append(b + c)
                        # from the neighbour's place this block lies the other way
                        for name, c in zip(("dx", "dy", "dz"), d, strict=True):
                            out[name].append(-c)
                        out["cells"].append(np.ascontiguousarray(cut).tobytes())
                yield pa.RecordBatch.from_arrays([*[pa.array(out[k], pa.int32()) for k in list(out)[:6]], pa.array(out["cells"], pa.binary())], names=list(out))

    return blocks.select(*KEY, "cells").mapInArrow(run, _PART)


def _assembled(core: pa.Table, parts: pa.Table, h: int, side: int) -> np.ndarray:
    """A block with its halo."""
    wide = np.zeros((side + 2 * h,) * 3)
    if core.num_rows:
        wide[(slice(h, h + side),) * 3] = np.frombuffer(core["cells"][0].as_py()).reshape(side, side, side)
    directions = list(zip(*(parts[d].to_pylist() for d in ("dx", "dy", "dz")), strict=True))
    for d, cells in zip(directions, parts["cells"], strict=True):
        if d != (None, None, None):
            where = tuple(_place(c, h, side) for c in d)
            wide[where] = np.frombuffer(cells.as_py()).reshape([s.stop - s.start for s in where])
    return wide


def around(blocks: DataFrame, h: int, run: Stencil, schema: str, side: int = SIDE, absent: bool = False) -> DataFrame:
    """``x, y, z, intensity`` and what ``run`` gives (``schema``) for each voxel; with ``absent`` for every cell of each block.

    ``h`` is at most ``side``: a halo comes from the next blocks only.
    """
    if h > side:
        raise ValueError(f"a halo of {h} is wider than a block of {side}")
    names = [c.split()[0].strip("`") for c in schema.split(",")]

    def each(key: tuple, core: pa.Table, parts: pa.Table) -> pa.Table:
        empty = pa.table({**{a: pa.array([], pa.int32()) for a in AXES}, "intensity": pa.array([], pa.float64()), **{n: pa.array([], pa.float64()) for n in names}})
        if not core.num_rows:
            return empty
        origin = tuple(k.as_py() * side for k in key)
        wide = _assembled(core, parts, h, side)
        present = np.unpackbits(np.frombuffer(core["present"][0].as_py(), np.uint8), count=side**3).astype(bool).reshape((side,) * 3)
        at = np.nonzero(np.ones_like(present) if absent else present)
        found = run(wide, origin)
        own = wide[(slice(h, h + side),) * 3]
        return pa.table({**{a: pa.array((k + o).astype(np.int32)) for a, k, o in zip(AXES, at, origin, strict=True)}, "intensity": pa.array(own[at]), **{n: pa.array(np.asarray(found[n], float)[at]) for n in names}})

    return blocks.groupBy(*KEY).cogroup(faces(blocks, h, side).groupBy(*KEY)).applyInArrow(each, f"x int, y int, z int, intensity double, {schema}")


def _shifted(wide: np.ndarray, h: int, d: tuple[int, int, int]) -> np.ndarray:
    side = wide.shape[0] - 2 * h
    return wide[tuple(slice(h + c, h + c + side) for c in d)]


def convolve(blocks: DataFrame, offsets: list[tuple[int, int, int, float]], side: int = SIDE) -> DataFrame:
    """``x, y, z, intensity, local_mass``: the weighted sum of each voxel's surroundings (symmetric kernels)."""
    h = max(max(abs(a), abs(b), abs(c)) for a, b, c, _ in offsets)

    def run(wide: np.ndarray, origin: tuple) -> dict[str, np.ndarray]:
        return {"local_mass": sum(w * _shifted(wide, h, (a, b, c)) for a, b, c, w in offsets)}

    return around(blocks, h, run, "local_mass double", side)


def _cube_values(wide: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Layer by layer the sorted values of the cube around each cell."""
    side = wide.shape[0] - 2 * size
    span = range(-size, size + 1)
    for x in range(side):
        layer = wide[x : x + 2 * size + 1]
        cells = np.stack([layer[a + size, size + b : size + b + side, size + c : size + c + side] for a in span for b in span for c in span])
        cells.sort(axis=0)
        yield slice(x, x + 1), cells


def _summed(cells: np.ndarray, term: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``term(count)`` over the distinct values along the first axis, which is sorted."""
    n, out, run = len(cells), np.zeros(cells.shape[1:]), np.ones(cells.shape[1:])
    for k in range(1, n):
        same = cells[k] == cells[k - 1]
        out += np.where(same, 0.0, term(run))
        run = np.where(same, run + 1, 1.0)
    return out + term(run)


def local_entropy(blocks: DataFrame, size: int, base: float | None = None, side: int = SIDE) -> DataFrame:
    """``x, y, z, intensity, entropy``: entropy (natural, or to ``base``) of the values in the cube around each voxel."""
    cells = (2 * size + 1) ** 3

    def run(wide: np.ndarray, origin: tuple) -> dict[str, np.ndarray]:
        layers = [_summed(v, lambda n: -(n / cells) * np.log(n / cells)) for _, v in _cube_values(wide, size)]
        return {"entropy": np.stack(layers) / (math.log(base) if base else 1.0)}

    return around(blocks, size, run, "entropy double", side)


def density_entropy(blocks: DataFrame, size: int, bins: int, stride: int = 1, start: int = 0, side: int = SIDE) -> DataFrame:
    """``x, y, z, entropy`` at voxels every ``stride`` from ``start`` on each axis: base two, of the density of the values 0 to 255 around in ``bins`` bins.

    A density is a share divided by the width of a bin.
    """
    cells, width = (2 * size + 1) ** 3, 256 / bins

    def run(wide: np.ndarray, origin: tuple) -> dict[str, np.ndarray]:
        binned = np.floor(wide * bins / 256)
        term = lambda n: -(n / cells / width) * np.log2(n / cells / width)
        return {"entropy": np.stack([_summed(v, term) for _, v in _cube_values(binned, size)])}

    out = around(blocks, size, run, "entropy double", side)
    for a in AXES:
        out = out.where(F.pmod(F.col(a), F.lit(stride)) == start)
    return out.select(*AXES, "entropy")


#: Bytes of patches that one task makes of a block; fuller blocks are dealt to several tasks.
PATCH_BYTES = 64 << 20


def _taken(wide: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Patches around cells ``at`` (numbered without the halo, which is ``size``), a row each, x fastest."""
    views = np.lib.stride_tricks.sliding_window_view(wide, (2 * size + 1,) * 3)
    return views[tuple(at.T)].transpose(0, 3, 2, 1).reshape(len(at), -1)


def patches(blocks: DataFrame, centres: DataFrame, size: int, side: int = SIDE) -> DataFrame:
    """``id, patch``: (2s+1)**3 values in row-major z, y, x order around each of ``centres(id, x, y, z)``, which needn't be voxels.

    Centres go to their block and take their patches from it and its faces. Where a block has more than one task's share
    of centres, it is sent with its halo to as many tasks as they need.
    """
    kind, most = centres.schema["id"].dataType.simpleString(), max(1, PATCH_BYTES // (8 * (2 * size + 1) ** 3))
    at = [F.floor(F.col(a) / side).cast("int").alias(b) for a, b in zip(AXES, KEY, strict=True)]
    placed = centres.select(*at, "id", *[F.col(a).cast("int").alias(a) for a in AXES])
    full = placed.groupBy(*KEY).count().where(F.col("count") > most).select(*KEY, F.ceil(F.col("count") / most).cast("int").alias("units"))
    none = [F.lit(None).cast("int").alias(d) for d in ("dx", "dy", "dz")]

    def cut(wide: np.ndarray, origin: list[int], rows: pa.Table) -> pa.Table:
        cells = np.stack([np.asarray(rows[a]) - o for a, o in zip(AXES, origin, strict=True)], axis=1).astype(int)
        found = _taken(wide, cells, size)
        values = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.reshape(-1)))
        return pa.table({"id": rows["id"].combine_chunks(), "patch": values})

    def each(key: tuple, core: pa.Table, parts: pa.Table) -> pa.Table:
        rows = parts.filter(parts["x"].is_valid())
        if not rows.num_rows:
            return pa.table({"id": parts["id"].slice(0, 0), "patch": pa.array([], pa.list_(pa.float64()))})
        return cut(_assembled(core, parts, size, side), [k.as_py() * side for k in key], rows)

    sent = faces(blocks, size, side)
    place = [F.lit(None).cast(kind).alias("id"), *[F.lit(None).cast("int").alias(a) for a in AXES]]
    few = placed.join(full, list(KEY), "left_anti").select(*KEY, *none, F.lit(None).cast("binary").alias("cells"), "id", *AXES)
    right = sent.select(*sent.columns, *place).unionByName(few)
    out = blocks.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInArrow(each, f"id {kind}, patch array<double>")
    if full.first() is None:
        return out

    def whole(key: tuple, core: pa.Table, parts: pa.Table) -> pa.Table:
        return _table([k.as_py() for k in key], cells=_assembled(core, parts, size, side).tobytes())

    def dealt(key: tuple, block: pa.Table, rows: pa.Table) -> pa.Table:
        wide = np.frombuffer(block["cells"][0].as_py()).reshape((side + 2 * size,) * 3) if block.num_rows else np.zeros((side + 2 * size,) * 3)
        return cut(wide, [k.as_py() * side for k in key[:3]], rows)

    crowded = blocks.join(full, list(KEY), "left_semi").groupBy(*KEY).cogroup(sent.join(full, list(KEY), "left_semi").groupBy(*KEY)).applyInArrow(whole, "bx int, by int, bz int, cells binary")
    copies = crowded.join(full, list(KEY)).select(*KEY, "cells", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"))
    # there are fewer full blocks than their share of the centres allows, so their centres stay where they are for this join
    many = placed.join(F.broadcast(full), list(KEY)).withColumn("unit", F.pmod(F.xxhash64("id", *AXES, F.monotonically_increasing_id()), F.col("units")).cast("int")).drop("units")
    keys = [*KEY, "unit"]
    return out.unionByName(copies.groupBy(*keys).cogroup(many.groupBy(*keys)).applyInArrow(dealt, f"id {kind}, patch array<double>"))


def scaled(blocks: DataFrame, change: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """Blocks with the values that are present changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                present = np.unpackbits(np.frombuffer(batch.column(4)[i].as_py(), np.uint8), count=side**3).astype(bool)
                v = np.where(present, change(np.frombuffer(batch.column(3)[i].as_py())), 0.0)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in range(3)], pa.array([v.tobytes()], pa.binary()), batch.column(4).slice(i, 1)], names=batch.schema.names)

    return blocks.select(*KEY, "cells", "present").mapInArrow(run, BLOCK)


def overlaid(blocks: DataFrame, box: dict[str, tuple[int, int]], size: int, stride: int, predict: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """Blocks of the mean of all predicted patches over each cell, sites every ``stride`` cells of ``box``; with ``low`` and ``high`` of each block.

    A block predicts the patches of its own sites, each once, and sends what reaches over its faces to its neighbours.
    """
    if size > side:
        raise ValueError(f"a patch that reaches {size} is wider than a block of {side}")
    spark, grid = blocks.sparkSession, None
    for a, b in zip(AXES, KEY, strict=True):
        low, high = box[a]
        part = spark.range(low // side, (high - 1) // side + 1).select(F.col("id").cast("int").alias(b))
        # the block numbers of a box, not its cells
        grid = part if grid is None else grid.crossJoin(part)
    sent = faces(blocks, size, side)
    right = sent.unionByName(grid.select(*KEY, *[F.lit(None).cast("int").alias(d) for d in ("dx", "dy", "dz")], F.lit(None).cast("binary").alias("cells")))

    def each(key: tuple, core: pa.Table, parts: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        out = {k: [] for k in (*KEY, "dx", "dy", "dz", "total", "n")}
        lines = []
        for k, a in zip(at, AXES, strict=True):
            low, high = box[a]
            first = max(low, low + -(-(k * side - low) // stride) * stride)
            lines.append(np.arange(first, min(high, (k + 1) * side), stride) - k * side)
        if all(len(x) for x in lines):
            sites = np.stack(np.meshgrid(*lines, indexing="ij"), axis=-1).reshape(-1, 3)
            found = np.asarray(predict(_taken(_assembled(core, parts, size, side), sites, size)), float)
            total, n = np.zeros((2, *(side + 2 * size,) * 3))
            span = range(2 * size + 1)
            for k, (c, b, a) in enumerate(itertools.product(span, repeat=3)):
                where = tuple((sites + (a, b, c)).T)
                total[where] += found[:, k]
                n[where] += 1
            for d in ((0, 0, 0), *DIRECTIONS):
                where = tuple(_place(c, size, side) for c in d)
                if n[where].any():
                    for name, k, c in zip(KEY, at, d, strict=True):
                        out[name].append(k + c)
                    for name, c in zip(("dx", "dy", "dz"), d, strict=True):
                        out[name].append(-c)
                    out["total"].append(np.ascontiguousarray(total[where]).tobytes())
                    out["n"].append(np.ascontiguousarray(n[where]).tobytes())
        return pa.table({k: pa.array(v, pa.binary() if k in ("total", "n") else pa.int32()) for k, v in out.items()})

    laid = blocks.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInArrow(each, "bx int, by int, bz int, dx int, dy int, dz int, total binary, n binary")

    def together(key: tuple, parts: pa.Table) -> pa.Table:
        total, n = np.zeros((2, side, side, side))
        directions = list(zip(*(parts[d].to_pylist() for d in ("dx", "dy", "dz")), strict=True))
        for d, a, b in sorted(zip(directions, parts["total"].to_pylist(), parts["n"].to_pylist(), strict=True)):
            where = tuple(_reach(c, size, side) for c in d)
            shape = [s.stop - s.start for s in where]
            total[where] += np.frombuffer(a).reshape(shape)
            n[where] += np.frombuffer(b).reshape(shape)
        on = n > 0
        v = np.where(on, total / np.maximum(n, 1), 0.0)
        row = _table([k.as_py() for k in key], cells=v.tobytes(), present=np.packbits(on).tobytes())
        return row.append_column("low", pa.array([v[on].min()])).append_column("high", pa.array([v[on].max()]))

    return laid.groupBy(*KEY).applyInArrow(together, f"{BLOCK}, low double, high double")
