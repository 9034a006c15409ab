"""Matchings, colourings, merges and fits against plain statements, at sizes and shapes that used to change how they work."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import markers, matching, shape


def best_weight(w):
    """Greatest total weight of a matching, by all ways to give each row a column or none."""
    n, m = w.shape
    best = {0: 0.0}
    for i in range(n):
        new = dict(best)
        for used, value in best.items():
            for j in range(m):
                if not used >> j & 1 and w[i, j] > 0:
                    key = used | 1 << j
                    new[key] = max(new.get(key, -1.0), value + w[i, j])
        best = new
    return max(best.values())


def test_matching_is_the_heaviest(spark):
    r = np.random.default_rng(1)
    rows, want = [], 0.0
    for g in range(40):
        n, m = r.integers(1, 7, 2)
        # whole weights make many ties
        w = np.where(r.random((n, m)) < 0.6, r.integers(1, 6, (n, m)) if g % 2 else r.random((n, m)), 0.0)
        want += best_weight(w)
        rows += [(100 * g + int(i), 100 * g + int(j), float(1 / w[i, j]), float(w[i, j])) for i, j in np.argwhere(w > 0)]
    pairs = spark.createDataFrame(rows, "a_id long, b_id long, d double, weight double")
    proof = matching.certificate(pairs, matching.solved(pairs)).first()
    assert proof.weight == pytest.approx(want) == pytest.approx(proof.bound)
    assert (proof.uncovered, proof.negative, proof.shared) == (0, 0, 0)
    assert matching.max_weight(pairs.limit(0)).count() == 0


def test_one_component_of_many_nodes():
    """A chain of 50,000 and 50,000 nodes with a few edges more, in memory for its edges, proved by its duals."""
    r = np.random.default_rng(2)
    n = 50_000
    a = np.concatenate([np.arange(n), np.arange(n - 1), r.integers(0, n, n)])
    b = np.concatenate([np.arange(n), np.arange(1, n), np.minimum(n - 1, a[2 * n - 1 :] + r.integers(0, 5, n))])
    edges, first = np.unique(a * n + b, return_index=True)
    a, b, w = a[first], b[first], r.random(len(edges)) + 0.01
    found = matching._Sparse(a, b, w)
    u, v, column = np.array(found.u), np.array(found.v), np.array(found.column)
    assert (u >= 0).all() and (v >= 0).all() and (u[a] + v[b] >= w - 1e-9).all()
    on = column >= 0
    assert len(set(column[on])) == on.sum()
    weight = dict(zip(edges.tolist(), w.tolist(), strict=True))
    total = sum(weight[i * n + j] for i, j in enumerate(column.tolist()) if j >= 0)
    assert total == pytest.approx(u.sum() + v.sum())


@pytest.mark.parametrize("more", ["first", "second"])
def test_matching_by_blocks_is_the_heaviest(spark, monkeypatch, more):
    """Points on whole numbers, so many weights tie; searches leave the small blocks. No pairs are listed, so no component is one task."""
    r = np.random.default_rng(12)
    cloud = lambda n: spark.createDataFrame([(k - 5, *map(float, x)) for k, x in enumerate(r.integers(0, 60, (n, 3)))], "id long, x double, y double, z double")
    few, many = cloud(500), cloud(650).unionByName(spark.createDataFrame([(9000, 500.0, 0.0, 0.0), (9001, None, 0.0, 0.0)], "id long, x double, y double, z double"))
    a, b = (many, few) if more == "first" else (few, many)
    pairs = matching.candidates(a, b, 14.0)
    want = matching.certificate(pairs, matching.solved(pairs)).first()
    rounds, cut = [], matching.cut
    with monkeypatch.context() as m:
        m.setattr(matching, "cut", lambda df: rounds.append(1) or cut(df))
        m.setattr(matching, "candidates", None)
        found = matching.solved_near(a, b, 14.0, share=20)
    proof = matching.certificate(pairs, found).first()
    assert len(rounds) > 3
    assert proof.weight == pytest.approx(want.weight) == pytest.approx(proof.bound)
    assert (proof.uncovered, proof.negative, proof.shared) == (0, 0, 0)
    assert matching.max_weight_near(a, b, 14.0).join(pairs, ["a_id", "b_id", "d"], "left_anti").isEmpty() and matching.max_weight_near(a.limit(0), b, 14.0).isEmpty()


def test_scores_by_weight_list_no_pairs(spark, monkeypatch):
    """Two rows and two columns of which the nearest pair isn't in the heaviest matching; no candidates are made."""
    cloud = lambda rows: spark.createDataFrame([(k, float(x), 50.0, 50.0) for k, x in rows], "id long, x double, y double, z double")
    a, b = cloud([(1, 50.0), (2, 52.1)]), cloud([(1, 51.0), (2, 48.9)])
    monkeypatch.setattr(matching, "candidates", None)
    counts, listed = matching.evaluate(a, b, (100, 100, 100), 10, 8.0)
    assert (lambda r: (r.tp, r.fp, r.fn))(counts.first()) == (2, 0, 0) and listed.count() == 2


@pytest.mark.parametrize("n", [998, 1001])
def test_colours_at_any_size(spark, n):
    path = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r.id: r.color for r in matching.hues(spark.range(n + 3), path).collect()}
    assert len(got) == n + 3 and all(got[k] != got[k + 1] for k in range(n)) and {got[k] for k in range(n + 1)} <= set(matching.HUES)


def test_colours_are_those_of_the_walk(spark):
    r = np.random.default_rng(3)
    edges = {tuple(sorted(map(int, e))) for e in r.integers(0, 80, (400, 2)) if e[0] != e[1]} | {(0, k) for k in range(1, 60)}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    near = {k: {b if a == k else a for a, b in edges if k in (a, b)} for k in range(85)}
    h = {x.id: x.h for x in spark.range(85).select("id", F.xxhash64("id", F.lit(0)).alias("h")).collect()}
    want = {}
    for k in sorted(range(85), key=lambda k: (len(near[k]), h[k], k), reverse=True):
        want[k] = next(c for c in itertools.count() if c not in {want[x] for x in near[k] if x in want})
    assert {x.id: x.color for x in matching.colored(spark.range(85), df).collect()} == want


def walk(rows, radius):
    alive = {}
    for tile in sorted({r[1] for r in rows}):
        before = sorted((k for k, ok in alive.items() if ok), key=lambda k: (rows[k][1], rows[k][0]))
        for k in sorted((k for k, r in enumerate(rows) if r[1] == tile), key=lambda k: rows[k][0]):
            alive[k] = True
            d = [(np.sqrt(sum((rows[k][2 + c] - rows[n][2 + c]) ** 2 for c in range(3))), i, n) for i, n in enumerate(before)]
            if d and min(d)[0] < radius:
                n = min(d)[2]
                alive[k if rows[k][5] < rows[n][5] else n] = False
    return {(rows[k][0], rows[k][1]) for k, ok in alive.items() if ok}


def test_merge_is_the_walk(spark):
    r = np.random.default_rng(4)
    rows = [(int(k), f"t{r.integers(0, 6)}", *map(float, np.round(r.uniform(0, 14, 3), 1)), float(r.integers(0, 5))) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, tile_id string, x double, y double, z double, depth double")
    for radius in (1.0, 2.5):
        assert {(m.id, m.tile_id) for m in markers.merge_in_order(df, radius).collect()} == walk(rows, radius)
    assert markers.merge_in_order(df, 1e-6).count() == len(rows) and markers.merge_in_order(df.limit(0), 2.0).count() == 0


def test_merge_of_a_long_chain(spark):
    """Ten thousand markers, each near the next, over six tiles."""
    r = np.random.default_rng(5)
    at, tile, depth = np.cumsum(r.uniform(0.5, 0.95, 10_000)), r.integers(0, 6, 10_000), r.integers(0, 9, 10_000)
    rows = [(k, f"t{tile[k]}", float(at[k]), 0.0, 0.0, float(depth[k])) for k in range(10_000)]
    # the walk looks along the chain only
    alive, place = np.zeros(10_000, bool), at
    for t in range(6):
        before = np.flatnonzero(alive)
        for k in np.flatnonzero(tile == t):
            alive[k] = True
            some = before[(place[before] > place[k] - 1) & (place[before] < place[k] + 1)]
            if len(some):
                n = min(some, key=lambda n: (abs(place[n] - place[k]), tile[n], n))
                alive[k if depth[k] < depth[n] else n] = False
    df = spark.createDataFrame(rows, "id long, tile_id string, x double, y double, z double, depth double")
    assert {m.id for m in markers.merge_in_order(df, 1.0).collect()} == set(np.flatnonzero(alive).tolist())


def test_fit_with_outliers(spark):
    r = np.random.default_rng(6)
    a = r.uniform(0, 50, (300, 3))
    c, s = np.cos(0.4), np.sin(0.4)
    turn, shift = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), np.array([3.0, -2, 7])
    b = a @ turn.T + shift
    b[::3] += r.uniform(10, 40, (100, 3))
    pairs = spark.createDataFrame([(k, *map(float, x), *map(float, y)) for k, (x, y) in enumerate(zip(a, b, strict=True))], "id long, x double, y double, z double, u double, v double, w double")
    got = shape.ransac(pairs.unionByName(pairs.limit(20)), trials=60)
    assert np.allclose(got[0], turn, atol=1e-6) and np.allclose(got[1], shift, atol=1e-5)


def test_closest_points_and_views(spark):
    """A cloud that is moved a little is moved back; views of one tile are fused in the first one's frame."""
    r = np.random.default_rng(7)
    a = np.round(r.uniform(0, 60, (120, 3)), 3)
    c, s = np.cos(0.02), np.sin(0.02)
    turn, shift = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), np.array([0.4, -0.3, 0.2])
    cloud = lambda x: spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "id long, x double, y double, z double")
    got = shape.icp(cloud(a), cloud(a @ turn.T + shift), 4.0, rounds=6)
    assert np.abs(a @ got[0].T + got[1] - (a @ turn.T + shift)).max() < 0.05
    first, second = a[:40], np.vstack([a[20:40] + 0.1, a[60:70]])
    match = lambda x, y: matching.greedy(matching.candidates(x, y, 1.0).select("a_id", "b_id", "d"))
    merged = markers.merge_views({("0", "90"): cloud(first), ("0", "270"): cloud(second)}, ("0", "90", "180", "270"), match, lambda x: x, (100, 100, 100)).toPandas().to_numpy()
    want = np.vstack([first[:20], first[20:] + 0.05, a[60:70]])
    assert len(merged) == len(want) and np.abs(np.sort(merged, axis=0) - np.sort(want, axis=0)).max() < 1e-9
