"""Block operators against plain numpy over the whole volume, and against the plans voxel by voxel."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import blocks, kernels, learning

SIDE = 5


@pytest.fixture(scope="module")
def volume():
    """A sparse volume that ends within a block, with empty blocks and one voxel below 0."""
    r = np.random.default_rng(1)
    v = np.where(r.random((13, 11, 17)) < 0.3, r.integers(1, 256, (13, 11, 17)), 0)
    v[5:10, 5:10, 5:10] = 0
    return v


def rows(spark, v, more=()):
    return spark.createDataFrame([(*map(int, p), int(v[tuple(p)])) for p in np.argwhere(v)] + list(more), "x int, y int, z int, intensity int")


def stored(spark, v, more=()):
    return blocks.store(blocks.pack(rows(spark, v, more), SIDE))


def wide(v, h):
    return np.pad(v, h)


def test_pack_and_store(spark, volume):
    kept = stored(spark, volume, [(-3, 0, 0, 7)])
    out = np.zeros_like(volume)
    for b in kept.collect():
        cells = np.frombuffer(bytes(b.cells)).reshape((SIDE,) * 3)
        present = np.unpackbits(np.frombuffer(bytes(b.present), np.uint8), count=SIDE**3).reshape((SIDE,) * 3)
        assert ((cells != 0) == present.astype(bool)).all()
        if (b.bx, b.by, b.bz) == (-1, 0, 0):
            assert cells[2, 0, 0] == 7 and present.sum() == 1
            continue
        lo = np.array([b.bx, b.by, b.bz]) * SIDE
        part = out[tuple(slice(k, k + SIDE) for k in lo)]
        part[:] = cells[tuple(slice(0, n) for n in part.shape)]
    assert (out == volume).all()
    plan = blocks.convolve(kept, kernels.ball(1), SIDE)._jdf.queryExecution().executedPlan().toString()
    # only the faces are shuffled: the blocks lie where they are needed
    assert plan.count("Exchange hashpartitioning") == 1, plan


@pytest.mark.parametrize("radius, soft", [(1, False), (2, True), (4, False)])
def test_convolve(spark, volume, radius, soft):
    offsets = kernels.ball(radius, soft)
    h = radius
    big = wide(volume.astype(float), h)
    want = sum(w * big[tuple(slice(h + k, h + k + n) for k, n in zip(o, volume.shape))] for *o, w in offsets)
    got = blocks.convolve(stored(spark, volume), offsets, SIDE).toPandas()
    assert len(got) == (volume > 0).sum()
    assert got.local_mass.to_numpy() == pytest.approx(want[got.x, got.y, got.z]) and (got.intensity == volume[got.x, got.y, got.z]).all()


def test_halo_is_at_most_a_block(spark, volume):
    with pytest.raises(ValueError, match="wider"):
        blocks.convolve(stored(spark, volume), kernels.ball(SIDE + 1), SIDE)


@pytest.mark.parametrize("size", [1, 2])
def test_entropies(spark, volume, size):
    v = volume // 40
    big, cells = wide(v, size), (2 * size + 1) ** 3
    natural, density = {}, {}
    for p in np.argwhere(v):
        cube = big[tuple(slice(k, k + 2 * size + 1) for k in p)]
        n = np.unique(cube, return_counts=True)[1] / cells
        natural[tuple(p)] = -(n * np.log(n)).sum()
        q = np.histogram(cube, 32, (0, 256), density=True)[0]
        q = q[q > 0]
        density[tuple(p)] = -(q * np.log2(q)).sum()
    b = stored(spark, v)
    got = {(r.x, r.y, r.z): r.entropy for r in blocks.local_entropy(b, size, side=SIDE).collect()}
    assert got == pytest.approx(natural)
    got = {(r.x, r.y, r.z): r.entropy for r in blocks.density_entropy(b, size, 32, side=SIDE).collect()}
    assert got == pytest.approx(density)
    some = {(r.x, r.y, r.z): r.entropy for r in blocks.density_entropy(b, size, 32, 3, 1, SIDE).collect()}
    assert some == pytest.approx({k: e for k, e in density.items() if all(c % 3 == 1 for c in k)})
    base = {(r.x, r.y, r.z): r.entropy for r in blocks.local_entropy(b, size, 2.0, SIDE).collect()}
    assert base == pytest.approx({k: e / np.log(2) for k, e in natural.items()})


@pytest.mark.parametrize("share", [blocks.PATCH_BYTES, 8 * 27 * 4])
def test_patches(spark, volume, monkeypatch, share):
    """Centres anywhere: beside the volume, in empty blocks, many at one place (dealt to several tasks in the second case)."""
    monkeypatch.setattr(blocks, "PATCH_BYTES", share)
    r = np.random.default_rng(2)
    at = [tuple(map(int, p)) for p in r.integers(-4, 22, (60, 3))] + [(7, 7, 7)] * 30 + [(100, 100, 100)]
    centres = spark.createDataFrame([(f"c{k}", *p) for k, p in enumerate(at)], "id string, x int, y int, z int")
    big = np.pad(volume, 120)
    got = {row.id: row.patch for row in blocks.patches(stored(spark, volume), centres, 1, SIDE).collect()}
    assert len(got) == len(at)
    for k, p in enumerate(at):
        x, y, z = (c + 120 for c in p)
        assert got[f"c{k}"] == big[x - 1 : x + 2, y - 1 : y + 2, z - 1 : z + 2].transpose(2, 1, 0).ravel().tolist()


def test_deconvolution_with_a_predictor(spark, volume):
    """A predictor that isn't the identity, sites that aren't in step with blocks, against one walk over all sites."""
    size, stride = 2, 3
    box = {"x": (1, 13), "y": (0, 11), "z": (2, 17)}
    mix = np.random.default_rng(3).normal(size=(125, 125)) / 40

    def predictor(x):
        return 1 / (1 + np.exp(-(x @ mix)))

    scaled = np.pad(volume / 255.0, size + 4)
    o = size + 4
    total, n = np.zeros_like(scaled), np.zeros_like(scaled)
    for p in itertools.product(*(range(*box[a], stride) for a in "xyz")):
        where = tuple(slice(o + c - size, o + c + size + 1) for c in p)
        out = predictor(scaled[where].transpose(2, 1, 0).ravel()[None])[0].reshape(5, 5, 5).transpose(2, 1, 0)
        total[where] += out
        n[where] += 1
    on = n > 0
    v = np.where(on, total / np.maximum(n, 1), 0)
    low, high = min(0.0, v[on].min()), v[on].max()
    v = np.where(on, (v - low) / max(high - low, 1.0), 0)
    sigma, reach = stride / 3, 2
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    for axis in range(3):
        v = np.apply_along_axis(lambda line: np.convolve(line, k / k.sum(), "same"), axis, v)
    want = np.minimum(255, np.floor(np.round(v * 255, 6)))
    got = learning.deconvolve(rows(spark, volume), box, size, stride, predictor).toPandas()
    inner = on[tuple(slice(o + box[a][0], o + box[a][1]) for a in "xyz")]
    assert len(got) == inner.sum()
    assert (got.intensity.to_numpy() == want[got.x + o, got.y + o, got.z + o]).all()


def test_plans_voxel_by_voxel_agree(spark, volume):
    r, b = rows(spark, volume), stored(spark, volume)
    key = lambda df, *c: sorted(tuple(row) for row in df.select("x", "y", "z", *c).collect())
    e = F.round("entropy", 9)
    assert key(blocks.local_entropy(b, 1, side=SIDE), e) == key(kernels.local_entropy(r, 1), e)
    m = F.round("local_mass", 9)
    assert key(blocks.convolve(b, kernels.ball(2), SIDE), m) == key(kernels.convolve(r, kernels.ball(2)), m)
