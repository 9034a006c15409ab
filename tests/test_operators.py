"""Operators against plain numpy statements of what they compute."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import detect, kernels, learning, markers, matching, shape, spatial, threshold, tiling
from voxelspark.sources import files, tiff


def cloud(spark, n, seed, span=40.0):
    r = np.random.default_rng(seed)
    x = np.round(r.uniform(0, span, (n, 3)) * 4) / 4
    mass = r.integers(1, 30, n).astype(float)
    rows = [(i, *map(float, p), float(m)) for i, (p, m) in enumerate(zip(x, mass))]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, mass double"), x, mass


def dist(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))


def test_joins(spark):
    (a, x, _), (b, y, _) = cloud(spark, 60, 1), cloud(spark, 70, 2)
    d = dist(x, y)
    for inclusive in (False, True):
        got = {(r.a_id, r.b_id) for r in spatial.distance_join(a, b, 8.0, inclusive).select("a_id", "b_id").collect()}
        assert got == set(zip(*map(list, np.nonzero(d <= 8.0 if inclusive else d < 8.0))))
    near = {}
    for r in spatial.knn_join(a, b, 4, 2.0).collect():
        near.setdefault(r.a_id, {})[r["rank"]] = r.b_id
    for i in range(60):
        assert [near[i][k] for k in (1, 2, 3, 4)] == sorted(range(70), key=lambda j: (d[i, j], j))[:4]
    assert spatial.knn_join(a.limit(0), b, 2, 1.0).count() == 0


def test_components(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)], "u long, v long")
    got = {r.id: r.component for r in spatial.components(nodes, edges).collect()}
    assert got == {k: {2: 1, 3: 1, 9: 1, 6: 5}.get(k, k) for k in range(12)}


def test_greedy_is_the_sequential_walk(spark):
    (a, x, _), (b, y, _) = cloud(spark, 80, 3), cloud(spark, 80, 4)
    d = dist(x, y)
    used_a, used_b, want = set(), set(), set()
    for v, i, j in sorted((d[i, j], i, j) for i in range(80) for j in range(80) if d[i, j] < 12):
        if i not in used_a and j not in used_b:
            want.add((i, j))
            used_a.add(i)
            used_b.add(j)
    got = matching.greedy(spatial.distance_join(a, b, 12.0).select("a_id", "b_id", "d"))
    assert {(r.a_id, r.b_id) for r in got.collect()} == want


def test_max_weight_is_the_best_of_all(spark):
    (a, x, _), (b, y, _) = cloud(spark, 6, 5, 12), cloud(spark, 5, 6, 12)
    d = dist(x, y)
    w = np.where(d < 12, 1 / np.maximum(0.001, d), 0)
    best = max(sum(w[i, j] for i, j in zip(p, range(5))) for p in itertools.permutations(range(6), 5))
    got = matching.max_weight(matching.candidates(a, b, 12.0)).collect()
    assert len({r.a_id for r in got}) == len({r.b_id for r in got}) == len(got)
    assert sum(w[r.a_id, r.b_id] for r in got) == pytest.approx(best)


def test_three_matchings_differ(spark):
    pairs = spark.createDataFrame([(1, 1, 1.0, 10.0), (1, 2, 1.1, 9.0), (2, 1, 1.1, 9.0)], "a_id long, b_id long, d double, weight double")
    assert [(r.a_id, r.b_id) for r in matching.greedy(pairs).collect()] == [(1, 1)]
    assert sorted((r.a_id, r.b_id) for r in matching.max_weight(pairs).collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("heavy", [True, False])
def test_suppression_is_the_sequential_walk(spark, heavy):
    p, x, mass = cloud(spark, 150, 7)
    kept = []
    for i in sorted(range(150), key=lambda i: (-mass[i] if heavy else mass[i], i)):
        if all(np.sqrt(((x[i] - x[j]) ** 2).sum()) > 6 for j in kept):
            kept.append(i)
    got = [r.id for r in matching.suppress(p, 6.0, heavy).collect()]
    assert sorted(got) == sorted(kept)


def test_prf_rules(spark):
    rows = [(0, 0, 0), (0, 3, 0), (0, 0, 3), (0, 2, 2), (4, 1, 3)]
    got = [tuple(r)[3:] for r in matching.prf(spark.createDataFrame(rows, "tp long, fp long, fn long")).collect()]
    assert got == [(1.0, 1.0, 1.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.8, pytest.approx(4 / 7, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))]


def test_tiles_by_arithmetic(spark):
    size, counts, margin = (50, 31, 20), (3, 2, 1), 6
    grid = tiling.tile_grid(spark, size, counts, margin)
    pts = spark.createDataFrame([(float(x), float(y), float(z)) for x in range(-1, 51, 3) for y in range(0, 32, 2) for z in (0, 19, 20)], "x double, y double, z double")
    want = pts.join(grid, tiling.in_tile()).select("tile_id", "x", "y", "z")
    got = tiling.assign_tiles(pts, size, counts, margin).select("tile_id", "x", "y", "z")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.select("x", "y", "z").distinct().count() == pts.where("x between 0 and 49 and y < 31 and z < 20").count()


def test_margin_boundary(spark):
    p = spark.createDataFrame([(10.0, 20.0, 20.0), (9.9, 20.0, 20.0)], "x double, y double, z double")
    assert [r[0] for r in p.select(tiling.inside((40, 40, 40), 10)).collect()] == [True, False]
    assert [r[0] > 0 for r in p.select(tiling.margin_depth((40, 40, 40), 10)).collect()] == [False, False]


def test_two_kapur_by_search(spark):
    r = np.random.default_rng(8)
    for kind in range(3):
        h = np.zeros(256, int)
        at = r.choice(256, [12, 40, 256][kind], replace=False)
        h[at] = r.integers(1, 50, len(at))
        df = spark.createDataFrame([(0, i, int(n)) for i, n in enumerate(h)], "g int, bin int, n long")

        def ent(a, b):
            n = h[a:b][h[a:b] > 0]
            return np.log(n.sum()) - (n * np.log(n)).sum() / n.sum() if len(n) else 0.0

        best = max(((round(ent(0, a) + ent(a, b) + ent(b, 256), 9), -a, -b) for a in range(1, 255) for b in range(a + 1, 256)))
        got = threshold.two_kapur(df, "g").first()
        assert (got.t0, got.t1) == (-best[1], -best[2])


def test_merge_of_tiles(spark):
    rows = [(1, "a", 0.0, 0.0, 0.0, 5.0), (2, "b", 7.9, 0.0, 0.0, 6.0), (3, "a", 100.0, 0.0, 0.0, 1.0), (4, "b", 108.0, 0.0, 0.0, 2.0), (5, "a", 1.0, 0.0, 0.0, 9.0), (6, "a", 200.0, 0.0, 0.0, 3.0), (7, "b", 200.0, 0.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, tile_id string, x double, y double, z double, depth double")
    assert sorted(r.id for r in markers.merge_tiles(df, 8.0).collect()) == [3, 4, 5, 7]


def test_rigid_fits(spark):
    r = np.random.default_rng(9)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    rot, t = q * np.sign(np.linalg.det(q)), np.array([1.0, -2.0, 3.0])
    x = r.normal(size=(30, 3)) * 20
    y = x @ rot.T + t
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double, z double, u double, v double, w double")
    for fit in (shape.horn, shape.arun):
        got, shift = fit(shape.moments(df).first().asDict())
        assert np.allclose(got, rot, atol=1e-7) and np.allclose(shift, t, atol=1e-6) and np.allclose(got @ got.T, np.eye(3), atol=1e-7)
    back = shape.rigid(shape.rigid(df, rot, t), rot, t, inverse=True).orderBy("id").toPandas()
    assert np.allclose(back[["x", "y", "z"]], x)


def test_mean_shift_finds_planted_balls(spark):
    r = np.random.default_rng(10)
    centres = np.array([[10, 10, 10], [28, 12, 30], [14, 30, 22]])
    seen = {}
    for c in centres:
        for d in itertools.product(range(-4, 5), repeat=3):
            if sum(v * v for v in d) <= 16:
                seen[tuple(c + np.array(d))] = 200 - 8 * int(sum(v * v for v in d))
    for _ in range(300):
        seen.setdefault(tuple(r.integers(0, 40, 3)), int(r.integers(5, 12)))
    voxels = spark.createDataFrame([(int(a), int(b), int(c), int(v)) for (a, b, c), v in seen.items()], "x int, y int, z int, intensity int")
    got = detect.find_cells(voxels, (40, 40, 40), (1, 1, 1), 0, seed_radius=3.0).select("x", "y", "z").toPandas().to_numpy()
    assert len(got) == 3 and dist(centres, got).min(axis=1).max() < 0.6


def test_plane_and_outliers():
    r = np.random.default_rng(11)
    x = np.column_stack([r.uniform(0, 40, 80), r.uniform(0, 40, 80), r.normal(0, 0.1, 80)])
    x[:3, 2] += 15
    fit = shape.lowess(x[:, :2], x, 20.0)
    away = np.sqrt(((fit - x) ** 2).sum(1))
    assert away[:3].min() > 5 * np.median(away[3:])
    flat = shape.isomap(x[3:], 8)
    assert np.corrcoef(dist(flat, flat).ravel(), dist(x[3:], x[3:]).ravel())[0, 1] > 0.95


def test_geodesic_patches(spark):
    p, x, _ = cloud(spark, 60, 12)
    edges = shape.knn_edges(p, 4, 8.0)
    g = np.full((60, 60), np.inf)
    np.fill_diagonal(g, 0)
    for r in edges.collect():
        g[r.u, r.v] = r.d
    for k in range(60):
        g = np.minimum(g, g[:, k : k + 1] + g[k : k + 1])
    got = {(r.seed, r.id): r.d for r in shape.geodesic_patches(edges, p.where("id < 3").select("id"), 25.0).collect()}
    assert got.keys() == {(s, j) for s in range(3) for j in range(60) if g[s, j] <= 25}
    assert all(v == pytest.approx(g[k]) for k, v in got.items())


def test_regional_maxima_and_plateaus(spark):
    v = {(0, 0, 0): 5, (1, 0, 0): 5, (2, 0, 0): 6, (5, 0, 0): 4, (6, 0, 0): 4, (9, 9, 9): 1}
    df = spark.createDataFrame([(*k, i) for k, i in v.items()], "x int, y int, z int, intensity int")
    got = {(r.x, r.y, r.z) for r in kernels.regional_maxima(df, spatial.components).collect()}
    assert got == {(2, 0, 0), (5, 0, 0), (6, 0, 0), (9, 9, 9)}


def test_predictor_sees_every_row(spark):
    df = spark.createDataFrame([(i, [float(i)] * 3) for i in range(11)], "id long, patch array<double>")
    got = learning.predict(df.repartition(2), lambda x: x * 2, np.ones(3), np.full(3, 2.0)).orderBy("id").collect()
    assert [r.patch[0] for r in got] == [i - 1.0 for i in range(11)]


def test_data_sets(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), [1.0, 2.0, 3.0, 4.0]) for i in range(100)], "id long, label int, features array<double>")
    b = learning.balanced(df)
    assert b.where("label = 1").count() == b.where("label = 0").count() == 25
    kinds = {tuple(r.features) for r in learning.view_dropout(df, 0.6).collect()}
    assert kinds == {(1.0, 2.0, 3.0, 4.0), (0.0, 0.0, 3.0, 4.0), (1.0, 2.0, 0.0, 0.0)}
    h = learning.halves(df).first()
    assert (h.first_view, h.second_view) == ([1.0, 2.0], [3.0, 4.0])
    assert learning.masked(df, "label").where("label = 0").first().features == [0.0] * 4


def test_tiff(spark, tmp_path):
    r = np.random.default_rng(13)
    for z in (4, 5, 6):
        (tmp_path / f"s_{z:04d}.tif").write_bytes(tiff.encode(r.integers(0, 256, (7, 9)).astype(np.uint8)))
    df = tiff.read_stack(spark, str(tmp_path))
    back = {row.z: tiff.decode(bytes(row.content)) for row in tiff.slices_as_bytes(df, 9, 7).collect()}
    assert all((back[z] == tiff.decode((tmp_path / f"s_{z:04d}.tif").read_bytes())).all() for z in (4, 5, 6))
    (tmp_path / "s_0009.tif").write_bytes(tiff.encode(np.zeros((7, 9), np.uint8)))
    with pytest.raises(ValueError, match="consecutive"):
        tiff.read_stack(spark, str(tmp_path))


def test_text_formats(spark, tmp_path):
    info = {"Width": 9, "Height": 8, "Depth": 7, "Margin": 2, "SubStacks": {"000000": {"Width": 5, "Height": 4, "Depth": 3, "X0": 0, "Y0": 1, "Z0": 2, "Files": ["a.tif"]}}}
    (tmp_path / "info.json").write_text(json.dumps(info))
    tiles = files.read_tiles(spark, str(tmp_path / "info.json"))
    assert tuple(tiles.first()) == ("000000", 0, 1, 2, 5, 4, 3, ["a.tif"], 2)
    files.write_tiles(tiles, {k: v for k, v in info.items() if k != "SubStacks"}, str(tmp_path / "again"))
    assert files.read_tiles(spark, str(tmp_path / "again")).collect() == tiles.collect()
    (tmp_path / "t.txt").write_text("v1 , 0 -1 0, 1 0 0, 0 0 1 , 10 -4 3.5 , 0 0 0\n")
    row = files.read_transforms(spark, str(tmp_path / "t.txt")).first()
    assert (row.id, row.r, row.t) == ("v1", [0, -1, 0, 1, 0, 0, 0, 0, 1], [10, -4, 3.5])
    (tmp_path / "l.csv").write_text("# x,y,z\n1, 2,3\n4,5 ,6\n")
    assert [tuple(r)[1:] for r in files.read_landmarks(spark, str(tmp_path / "l.csv")).collect()] == [(1, 2, 3), (4, 5, 6)]
    (tmp_path / "th" / "000001").mkdir(parents=True)
    (tmp_path / "th" / "000001" / "090").write_text("12,34")
    assert tuple(files.read_thresholds(spark, str(tmp_path / "th")).first()) == ("000001", "090", 12, 34)
    with pytest.raises(ValueError):
        files.parse_registration("0 1 2")
    assert files.parse_registration("0 1 2 0 0 0 1 2 2 1 4 4 2 10 1e-4 0.5 50 2")["iterations"] == [10]


def test_marker_files(spark, tmp_path):
    (tmp_path / "p.marker").write_text("##x,y,z,radius,shape,name,comment\n1,2,3,0,1,a,m=5.00\tv=2.0\thue=0.10\t\t1:2\t0.6:0.3:0.1\t4.5\n4,5,6,0,1,b,\n")
    got = markers.read_markers(spark, str(tmp_path / "p.marker")).orderBy("x").collect()
    assert (got[0].mass, got[0].volume, got[0].hue, got[0].evr) == (5.0, 2.0, 0.1, [0.6, 0.3, 0.1]) and got[1].mass is None
    (tmp_path / "g.marker").write_text("#x, y, z, radius, shape, name\n1,2,3,0,1,\n4,5,6,0,1,b\n")
    assert [r.name for r in markers.read_markers(spark, str(tmp_path / "g.marker"), True).collect()] == ["landmark 1", "b"]
    df = spark.createDataFrame([(0.4, 1.5, 2.0, "n", 1.0, 2.0, 0.5)], "x double, y double, z double, name string, mass double, volume double, hue double")
    markers.write_markers(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True).first()
    assert (back["##x"], back.y, back.z, back.comment) == ("1", "3", "3", "m=1.00\tv=2.00\thue=0.50")
    markers.write_markers(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_rounding(spark):
    row = spark.createDataFrame([(0.5, 1.5, 2.5)], "a double, b double, c double").select(F.rint("a"), F.rint("c"), F.round("a"), F.round("c")).first()
    assert tuple(row) == (0.0, 2.0, 1.0, 3.0)
