"""Mutual information with its slopes against a plain statement of it, and registrations that must find a known motion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import registration as reg
from voxelspark.sources import files


def rows(spark, v):
    return spark.createDataFrame([(*map(int, p), float(v[tuple(p)])) for p in np.argwhere(v)], "x int, y int, z int, intensity double")


def spots(shape, centres, width):
    grid = np.stack(np.meshgrid(*(np.arange(n) for n in shape), indexing="ij"), axis=-1)
    return sum(a * np.exp(-((grid - c) ** 2).sum(-1) / (2 * width * width)) for a, c in centres)


def plain(fixed, moving, q, t, centre, bins=reg.BINS):
    """The metric by loops over all voxels."""
    r, _ = reg.turned(np.asarray(q))
    width = lambda v: (v.max() - v.min()) / (bins - 4)
    place = lambda x, v: (x - v.min()) / width(v) + 2
    p = np.zeros((bins, bins))
    for at in np.ndindex(fixed.shape):
        to = r @ (np.array(at) - centre) + centre + t
        if (to < 0).any() or (to > np.array(moving.shape) - 1).any():
            continue
        low = np.minimum(np.floor(to), np.array(moving.shape) - 2).astype(int)
        part = to - low
        value = sum(np.prod(np.where(k, part, 1 - part)) * moving[tuple(low + k)] for k in np.ndindex(2, 2, 2))
        f = int(np.clip(np.floor(place(fixed[at], fixed)), 2, bins - 3))
        u = place(value, moving)
        b = int(np.clip(np.floor(u), 2, bins - 3))
        for m in range(b - 1, b + 3):
            d = abs(m - u)
            p[f, m] += (4 - 6 * d**2 + 3 * d**3) / 6 if d < 1 else (2 - d) ** 3 / 6 if d < 2 else 0
    p /= p.sum()
    some = p > 1e-16
    return (p[some] * np.log(p[some] / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))[some])).sum()


@pytest.fixture(scope="module")
def pair():
    r = np.random.default_rng(2)
    shape = (9, 8, 7)
    fixed = spots(shape, [(200, r.uniform(1, 6, 3)) for _ in range(5)], 1.8) + 1
    return fixed, spots(shape, [(180, r.uniform(1, 6, 3)) for _ in range(5)], 1.8) + 2


def test_value_and_slopes(spark, pair):
    fixed, moving = pair
    size, centre = fixed.shape, (np.array(fixed.shape) - 1) / 2
    f, m = rows(spark, fixed), rows(spark, moving)
    points = reg.sample(f, size, 10**6, reg.Scale.of(fixed.min(), fixed.max(), reg.BINS))
    assert points.count() == fixed.size
    scale = reg.Scale.of(moving.min(), moving.max(), reg.BINS)
    at = np.array([0.03, -0.05, 0.08, 0.0, 0.3, -0.4, 0.21])
    at[3] = np.sqrt(1 - (at[:3] ** 2).sum())
    value, slopes = reg.mattes(points, m, size, at, centre, scale)
    assert value == pytest.approx(plain(fixed, moving, at[:4], at[4:], centre), abs=1e-9)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        up, down = (reg.mattes(points, m, size, at + s, centre, scale)[0] for s in (step, -step))
        assert slopes[k] == pytest.approx((up - down) / 2e-6, abs=2e-4), k


def test_slopes_of_a_shrunk_volume(spark, pair):
    fixed, moving = pair
    f, m = rows(spark, fixed), reg.shrink(rows(spark, moving), (2, 1, 2))
    size, small, centre = fixed.shape, (5, 8, 4), (np.array(fixed.shape) - 1) / 2
    points = reg.sample(f, size, 10**6, reg.Scale.of(fixed.min(), fixed.max(), 20))
    scale, at = reg.Scale.of(0.0, float(moving.max()) + 1, 20), np.array([0.02, 0.01, -0.04, 0.999, 0.13, -0.2, 0.17])
    _, slopes = reg.mattes(points, m, small, at, centre, scale, factors=(2, 1, 2))
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        up, down = (reg.mattes(points, m, small, at + s, centre, scale, factors=(2, 1, 2))[0] for s in (step, -step))
        assert slopes[k] == pytest.approx((up - down) / 2e-6, abs=1e-3), k


def test_slopes_of_a_turn():
    q = np.array([0.1, -0.2, 0.3, 0.8])
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert reg.turned(q)[1][k] == pytest.approx((reg.turned(q + step)[0] - reg.turned(q - step)[0]) / 2e-6, abs=1e-8)


def test_sample_is_seeded_and_bounded(spark, pair):
    f = rows(spark, pair[0]).where("z > 0")
    scale = reg.Scale.of(0.0, 256.0, reg.BINS)
    draw = lambda seed: {tuple(r) for r in reg.sample(f, (9, 8, 7), 60, scale, seed).collect()}
    a = draw(1)
    assert 40 < len(a) <= 60 and a == draw(1) != draw(2)
    # where nothing lies the value is 0, in the first bin
    assert {r[4] for r in a if r[3] == 0} <= {reg.PADDING} and len({r[4] for r in a}) > 3


TEXT = """0 1 2
0 0 0
2
2 2 1
2 2 1
25 25
{rate} {fine}
{scale}
{samples}
{metric}
"""


def moved(shape, turn, shift, centres):
    c = (np.array(shape) - 1) / 2
    r, _ = reg.turned(np.append(turn, np.sqrt(1 - (np.array(turn) ** 2).sum())))
    return r, c, spots(shape, [(a, r @ (p - c) + c + shift) for a, p in centres], 3.0)


def test_registration_by_its_parameters(spark):
    """The motion that made the moving volume is found from a sample, in the steps and levels of a parameter file."""
    shape, rng = (28, 26, 14), np.random.default_rng(4)
    centres = [(rng.uniform(120, 250), rng.uniform([5, 5, 3], [23, 21, 11])) for _ in range(9)]
    fixed = spots(shape, centres, 3.0)
    turn, shift = np.array([0.0, 0.0, 0.04]), np.array([1.4, -1.1, 0.3])
    r, c, moving = moved(shape, turn, shift, centres)
    parameters = files.parse_registration(TEXT.format(rate=0.004, fine=0.0008, scale=0.002, samples=6000, metric=1))
    log = []
    fit = reg.from_parameters(rows(spark, fixed), rows(spark, moving), shape, shape, parameters, log=log)
    probe = np.array([p for _, p in centres])
    want = (probe - c) @ r.T + c + shift
    got = (probe - fit.centre) @ fit.rotation().T + fit.centre + fit.shift
    before, after = (np.sqrt(((x - want) ** 2).sum(1)).mean() for x in (probe, got))
    assert after < 0.35 * before, (before, after, fit)
    assert {k for k, *_ in log} == {0, 1} and len(log) <= 50
    # over the first level the metric has risen
    first = [v for k, _, v, *_ in log if k == 0]
    assert max(first[5:]) > first[0]


def test_axes_are_turned_first(spark):
    """A moving volume with its axes exchanged and one flipped is the same volume once they are put right."""
    shape, rng = (12, 9, 7), np.random.default_rng(6)
    v = spots(shape, [(200, rng.uniform(1, 6, 3)) for _ in range(4)], 2.0)
    # axis 0 of the result is axis 1 of the file, turned round
    there = np.ascontiguousarray(np.transpose(v[::-1], (1, 0, 2)))
    text = TEXT.format(rate=1e-9, fine=1e-9, scale=1.0, samples=10**6, metric=2).replace("0 1 2", "1 0 2").replace("0 0 0", "1 0 0").replace("2 2 1", "1 1 1").replace("2\n1 1 1", "1\n1 1 1", 1)
    text = text.replace("25 25", "1").replace("1e-09 1e-09", "1e-09")
    fit = reg.from_parameters(rows(spark, v), rows(spark, there), shape, there.shape, files.parse_registration(text))
    alone = reg.descend(rows(spark, v), rows(spark, v), shape, shape, [reg.Level((1, 1, 1), (1, 1, 1), 1, 1e-9)], 10**6)
    assert fit.metric == pytest.approx(alone.metric, abs=1e-9) and fit.metric > 0.5


def test_too_few_samples_inside(spark, pair):
    f = rows(spark, pair[0])
    with pytest.raises(ValueError, match="too few"):
        reg.descend(f, f, (9, 8, 7), (9, 8, 7), [reg.Level((1, 1, 1), (1, 1, 1), 3, 1e-3)], 200, start=np.array([0, 0, 0, 1.0, 500, 0, 0]))
    with pytest.raises(ValueError, match="metric"):
        reg.from_parameters(f, f, (9, 8, 7), (9, 8, 7), files.parse_registration(TEXT.format(rate=1, fine=1, scale=1, samples=5, metric=0)))


def test_steps_read_the_sample_only(spark, pair):
    """The joined rows of a step are eight a sample: the moving volume isn't shuffled."""
    seen = []
    points = reg.sample(rows(spark, pair[0]), (9, 8, 7), 50, reg.Scale.of(0.0, 256.0, 50))
    real = F.broadcast
    try:
        F.broadcast = lambda df: seen.append(df.count()) or real(df)
        reg.mattes(points, rows(spark, pair[1]), (9, 8, 7), np.array([0, 0, 0, 1.0, 0, 0, 0]), np.full(3, 3.0), reg.Scale.of(0.0, 256.0, 50), 50)
    finally:
        F.broadcast = real
    assert seen and seen[0] <= 8 * 50
