"""What keeps a query's work in proportion to its input: radii, plans and exact sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import learning, matching, shape, spatial
from voxelspark.plans import catalog


def _cloud(n, side, seed=1, copies=0):
    x = np.random.default_rng(seed).integers(0, side, (n, 3)).astype(float)
    x[:copies] = x[0]
    return x


def _points(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")


@pytest.mark.parametrize("copies, own", [(0, False), (40, False), (40, True)])
def test_nearest_of_a_dense_cloud_start_narrow(spark, monkeypatch, copies, own):
    """A radius fit for few points isn't kept where there are many; copies and ties come out as by brute force."""
    a, b = _cloud(300, 30, 2, copies), _cloud(1500, 30, 3, copies)
    a = b if own else a
    radii, join = [], spatial.distance_join
    monkeypatch.setattr(spatial, "distance_join", lambda left, right, radius, **k: radii.append(radius) or join(left, right, radius, **k))
    got = sorted((r.a_id, r["rank"], r.b_id) for r in spatial.knn_join(_points(spark, a), _points(spark, b), 3, 64.0, other_than_self=own).collect())
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    if own:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got == [(i, k + 1, int(order[i, k])) for i in range(len(a)) for k in range(3)]
    assert max(radii[:1]) < 10


def test_nearest_within_a_reach(spark):
    a, b = _cloud(50, 60, 4), _cloud(50, 60, 5)
    got = sorted((r.a_id, r.b_id) for r in spatial.knn_join(_points(spark, a), _points(spark, b), 1, 2.0, within=12.0).collect())
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert got == [(i, int(np.argmin(d[i]))) for i in range(50) if d[i].min() <= 12]


def test_equal_values_of_many_tasks_have_no_deviation(spark):
    """The means that tasks put together differ in their last digit; a position where all values are equal stays null."""
    # 1 / 49 * 49 is below 1
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), (F.lit(1) + F.when(F.col("id") % 4 == 0, p).otherwise(0)).alias("v")) for p in (0, 1)]))
    values = spark.range(0, 49 * 8, 1, 8).select("id", kinds.alias("e")).select("id", "e.pos", "e.v")
    got = learning.standardized(values, "pos", "v").groupBy("pos").agg(F.count("value").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, 0, None, None), (1, 392, -0.57735, 1.732051)]


def test_distance_join_never_broadcasts(spark):
    p = _points(spark, _cloud(100, 20))
    plan = spatial.distance_join(p, p, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan


def test_regression_meets_places_not_points(spark, monkeypatch):
    """Points over one place of the plane are one row of the join; values as by least squares over all others."""
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 6, (200, 2)) * 7.0, rng.integers(0, 50, 200) + 1e6])
    met, join = [], shape.distance_join
    monkeypatch.setattr(shape, "distance_join", lambda left, right, *a, **k: met.append(left.count()) or join(left, right, *a, **k))
    got = {r.id: (r.n, r.z) for r in shape.local_plane(_points(spark, x), 10.0).collect()}
    assert met == [len(np.unique(x[:, :2], axis=0))]
    for i in range(len(x)):
        w = np.exp(-((x[:, :2] - x[i, :2]) ** 2).sum(axis=1) / 100)
        w[i] = 0
        fit = shape._local_fit(x[:, :2], x, x[i, :2], w, 1e-4)
        assert got[i][0] == (w > 1e-4).sum() and abs(got[i][1] - fit[2]) < 1e-5


def test_sites_are_merged_axis_by_axis(spark, small):
    """No step carries on a marker's sites that others have as well: distinct places go from axis to axis."""
    from voxelspark.plans import catalog

    plan = catalog.QUERIES["positive_sites"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 4 and plan.count("Generate explode") == 3


@pytest.mark.parametrize("side, lattice", [(12.0, 8_000_000), (12.0, 10), (1000.0, 8_000_000)])
def test_ball_sums_without_pairs(spark, monkeypatch, side, lattice):
    """Sums over balls as by brute force, with ends at the radius, copies, ids that repeat, places off the lattice; no row a pair is made."""
    monkeypatch.setattr(spatial, "LATTICE", lattice)
    r = np.random.default_rng(12)
    p = r.integers(0, 30, (1500, 3)).astype(float)
    p[:30] = p[0]
    w = r.integers(1, 2000, len(p)) / 100
    c = np.concatenate([p[:200] + r.integers(-2, 3, (200, 3)) * np.array([0.5, 0.5, 1.25]), r.random((100, 3)) * 40 - 5, [[900.0, 0.0, 0.0]]])
    joined = []
    monkeypatch.setattr(spatial, "distance_join", lambda *a, **k: joined.append(a))
    points = spark.createDataFrame([(*map(float, x), float(v)) for x, v in zip(p, w, strict=True)] + [(None, 1.0, 1.0, 1.0)], "x double, y double, z double, w double")
    centres = spark.createDataFrame([(k // 2, *map(float, x)) for k, x in enumerate(c)] + [(999, None, 1.0, 1.0)], "id long, x double, y double, z double")
    got = {(g.id, g.x, g.y, g.z): (g.n, g.s) for g in spatial.ball_sums(centres, points, 5.0, {"s": F.col("w")}, side=side).collect()}
    near = np.sqrt(((c[:, None] - p[None]) ** 2).sum(axis=2)) <= 5
    assert not joined and len(got) == len({(k // 2, *x) for k, x in enumerate(c.tolist())}) + 1 and got[999, None, 1.0, 1.0] == (0, 0.0)
    for k, x in enumerate(c.tolist()):
        n, s = got[(k // 2, *x)]
        assert n == near[k].sum() and s == pytest.approx(w[near[k]].sum(), abs=1e-8)


@pytest.mark.parametrize("whole, side", [(True, 9.0), (True, 66.0), (False, 9.0)])
def test_shells_without_pairs(spark, monkeypatch, whole, side):
    """Pairs by distance as by brute force, with copies, ids that repeat and distances at the ends of bins; no row a pair is made."""
    x = _cloud(900, 25, 13, 20) + (0 if whole else np.random.default_rng(1).integers(0, 2, (900, 3)) * 0.5) - 7
    joined = []
    monkeypatch.setattr(spatial, "distance_join", lambda *a, **k: joined.append(a))
    ids = np.arange(len(x))
    ids[-40:] = ids[:40]
    points = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, x, strict=True)] + [(None, 1.0, 1.0, 1.0), (5, None, 1.0, 1.0)], "id long, x double, y double, z double")
    got = {g.bin: g.n for g in spatial.shell_counts(points, 3.0, 6.5, 0.5, side=side).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[ids[:, None] < ids[None]]
    bins, n = np.unique(np.floor((d[(d >= 3) & (d < 6.5)] - 3) / 0.5).astype(int), return_counts=True)
    assert not joined and got == dict(zip(bins.tolist(), n.tolist(), strict=True))


def test_pairs_by_blocks(spark, small):
    """All pairs of different ids, both ways round, from blocks: no row meets a row in a join, and halves are rounded as SQL does."""
    r = np.random.default_rng(21)
    x = np.concatenate([r.integers(-40, 40, (300, 3)).astype(float), r.uniform(-40, 40, (100, 3))])
    rows = [(k - 7, *map(float, p)) for k, p in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[3], (rows[5][0], 1.0, 1.0, 1.0), (900, None, 1.0, 1.0)], "id long, x double, y double, z double")
    have = [*rows, rows[3], (rows[5][0], 1.0, 1.0, 1.0)]
    at = np.array([p[1:] for p in have])
    gap = at[:, None] - at[None]
    d = np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2)
    want = sorted((have[i][0], have[j][0], float(d[i, j])) for i, j in np.argwhere(d < 13) if have[i][0] != have[j][0])
    assert sorted(tuple(p) for p in spatial.near_pairs(df, 13.0).collect()) == want
    assert spatial.half_up(np.array([0.0000005, 0.1234565, 1.0000015, -0.0000005, 2.5e-7]), 6).tolist() == [1e-6, 0.123457, 1.000002, -1e-6, 0.0]
    assert "Join" not in catalog.QUERIES["gaussian_kernel"](spark, small)._jdf.queryExecution().toString()


@pytest.mark.parametrize("side", [None, 9.0])
def test_greedy_by_blocks_is_the_sequential_walk(spark, monkeypatch, side):
    """Whole coordinates make many ties; small blocks leave much unsure at first. No list of all pairs is made."""
    a, b = _cloud(700, 30, 31), _cloud(600, 30, 32) - 0.5
    gap = a[:, None] - b[None]
    d = np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2)
    want, used_a, used_b = set(), set(), set()
    for v, i, j in sorted((d[i, j], i, j) for i, j in np.argwhere(d < 4)):
        if i not in used_a and j not in used_b:
            want.add((int(i), int(j), float(v)))
            used_a.add(i)
            used_b.add(j)
    monkeypatch.setattr(matching, "distance_join", None)
    assert {tuple(r) for r in matching.greedy_near(_points(spark, a), _points(spark, b), 4.0, side).collect()} == want


def test_patches_by_blocks_are_those_of_the_rounds(spark, monkeypatch):
    """Bit for bit the distances of the frontier rounds, which aren't run; a point without coordinates is its own patch."""
    p = _points(spark, _cloud(300, 60, 41)).unionByName(spark.createDataFrame([(900, None, 1.0, 1.0)], "id long, x double, y double, z double"))
    edges = shape.knn_edges(p.where("x IS NOT NULL"), 4, 16.0).localCheckpoint()
    want = {tuple(r) for r in shape.geodesic_patches(edges, p.select("id"), 25.0).collect()}
    monkeypatch.setattr(shape, "geodesic_patches", None)
    got = shape.geodesic_near(p, edges, 25.0).collect()
    assert len(got) == len(want) > 1000 and {tuple(r) for r in got} == want


def test_candidates_by_blocks(spark, small):
    """Pairs of two lists from blocks, whatever their ids: no row meets a row in a join."""
    r = np.random.default_rng(22)
    make = lambda n, k: [(int(i), *map(float, p)) for i, p in zip(r.integers(0, k, n), r.integers(-40, 40, (n, 3)) / 2, strict=True)]
    a, b = make(300, 500), make(400, 200)
    df = lambda rows: spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "id long, x double, y double, z double")
    at, to = (np.array([p[1:] for p in rows]) for rows in (a, b))
    gap = at[:, None] - to[None]
    d = np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2)
    want = sorted((a[i][0], b[j][0], float(d[i, j])) for i, j in np.argwhere(d < 9))
    assert sorted(tuple(p)[:3] for p in matching.candidates(df(a), df(b), 9.0).collect()) == want
    assert "Join" not in catalog.QUERIES["match_candidates"](spark, small)._jdf.queryExecution().toString()


@pytest.mark.parametrize("side", [None, 9.0, 5.0])
def test_greedy_with_ids_that_repeat(spark, monkeypatch, side):
    """Rows of one id are one end wherever they lie; no list of all pairs is made, and a crowd is walked by stages."""
    monkeypatch.setattr(matching, "distance_join", None)
    monkeypatch.setattr(matching, "WHOLE", 100)
    a, b = _cloud(900, 20, 51), _cloud(900, 20, 52) - 0.5
    r = np.random.default_rng(53)
    ia, ib = r.permutation(900), r.integers(0, 700, 900)
    gap = a[:, None] - b[None]
    d = np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2)
    want, used_a, used_b = set(), set(), set()
    for v, i, j in sorted((d[i, j], ia[i], ib[j]) for i, j in np.argwhere(d < 4)):
        if i not in used_a and j not in used_b:
            want.add((int(i), int(j), float(v)))
            used_a.add(i)
            used_b.add(j)
    df = lambda ids, x: spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, x, strict=True)], "id long, x double, y double, z double")
    got = [tuple(r) for r in matching.greedy_near(df(ia, a), df(ib, b), 4.0, side).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("side, heavy", [(None, True), (9.0, False)])
def test_suppression_by_blocks(spark, monkeypatch, side, heavy):
    """The rows that a walk over all of them keeps, with masses that tie and ids that repeat; no list of pairs is made."""
    monkeypatch.setattr(matching, "distance_join", None)
    r = np.random.default_rng(61)
    x, ids, mass = _cloud(900, 30, 62), np.concatenate([np.arange(800), r.integers(0, 800, 100)]), r.integers(0, 40, 900).astype(float)
    gap = x[:, None] - x[None]
    pairs = np.argwhere(np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2) <= 4)
    near = {int(i): set() for i in ids}
    for i, j in pairs:
        if ids[i] != ids[j]:
            near[int(ids[i])].add(int(ids[j]))
    kept = []
    for k in sorted(range(900), key=lambda k: (-mass[k] if heavy else mass[k], ids[k])):
        if not near[int(ids[k])] & set(kept):
            kept.append(int(ids[k]))
    rows = [(int(i), *map(float, p), float(m)) for i, p, m in zip(ids, x, mass, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0), (2000, None, 1.0, 1.0, 1.0)]
    got = matching.suppress(spark.createDataFrame(rows, "id long, x double, y double, z double, mass double"), 4.0, heavy, side=side)
    assert sorted(g.id for g in got.collect() if g.id is not None) == sorted([*kept, 2000])
