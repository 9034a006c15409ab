"""Thresholds of any number, sweeps over an attribute, pivots, targets, running sums."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import same, sql
from voxelspark.functions.numbering import running
from voxelspark.operators import learning, matching, threshold
from voxelspark.plans import catalog

MORE = "/root/testdata/sf0.01"


def entropy(n):
    n = n[n > 0]
    return np.log(n.sum()) - (n * np.log(n)).sum() / n.sum() if len(n) else 0.0


@pytest.mark.parametrize("cuts", [1, 2, 3, 4, 5])
def test_any_number_of_cuts(spark, cuts):
    r, bins = np.random.default_rng(cuts), 11
    hists = {"flat": np.ones(bins, int), "none": np.zeros(bins, int), "one": np.eye(bins, dtype=int)[4] * 9, "steps": np.repeat([5, 0, 7], [4, 3, 4])} | {f"r{k}": r.integers(0, 30, bins) * (r.random(bins) < 0.7) for k in range(6)}
    want = {}
    for name, h in hists.items():
        ends = [(0, *t, bins) for t in itertools.combinations(range(1, bins), cuts)]
        want[name] = max((round(sum(entropy(h[a:b]) for a, b in itertools.pairwise(t)), 9), *(-c for c in t[1:-1])) for t in ends)[1:]
    df = spark.createDataFrame([(k, i, int(n)) for k, h in hists.items() for i, n in enumerate(h)], "g string, bin int, n long")
    got = {row.g: tuple(-row[f"t{k}"] for k in range(cuts)) for row in threshold.multi_kapur(df, "g", cuts, bins).collect()}
    assert got == want


def test_cuts_need_bins(spark):
    with pytest.raises(ValueError, match="cuts"):
        threshold.multi_kapur(spark.createDataFrame([("a", 0, 1)], "g string, bin int, n long"), "g", 0)


@pytest.mark.parametrize("name", ["three_kapur", "two_kapur", "max_entropy_attr", "gaussian_target", "model_scores", "model_pivot", "model_pivot_transposed"])
def test_sql(spark, small, name):
    same(catalog.QUERIES[name](spark, small).toPandas(), sql(catalog.ORACLE[name], small))


@pytest.mark.parametrize("name", ["pr_curve", "pr_best", "pr_entropy"])
def test_sweep_sql(spark, name):
    """The SQL matches anew for each value of the attribute."""
    got = catalog.QUERIES[name](spark, MORE).toPandas()
    assert len(got) > (100 if name == "pr_curve" else 0)
    same(got, sql(catalog.ORACLE[name], MORE))


def walk(true, pred, radius):
    d = sorted((float(np.sqrt(((a - b) ** 2).sum())), i, j) for i, a in enumerate(true) for j, b in enumerate(pred) if b is not None)
    used_a, used_b = set(), set()
    for x, i, j in d:
        if x < radius and i not in used_a and j not in used_b:
            used_a.add(i), used_b.add(j)
    return used_a, used_b


def test_sweep_by_hand(spark):
    """Crowded markers with repeated attributes, some outside, one null."""
    r = np.random.default_rng(5)
    true, pred, attr = r.uniform(0, 30, (40, 3)), r.uniform(0, 30, (60, 3)), r.integers(0, 12, 60).astype(float)
    inside = lambda x: bool(((x >= 3) & (x <= 27)).all())
    t = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(true)], "id long, x double, y double, z double")
    p = spark.createDataFrame([(k, *map(float, x), float(a)) for k, (x, a) in enumerate(zip(pred, attr, strict=True))] + [(99, 5.0, 5.0, 5.0, None)], "id long, x double, y double, z double, mass double")
    want = {}
    for v in sorted({a for a, x in zip(attr, pred, strict=True) if inside(x)} | {4.5}):
        live = [x if a > v else None for x, a in zip(pred, attr, strict=True)]
        n = sum(x is not None and inside(x) for x in live)
        if n > 5:
            a, b = walk(true, live, 6.0)
            tp = sum(inside(true[i]) for i in a)
            want[v] = (n, tp, n - sum(inside(pred[j]) for j in b), sum(map(inside, true)) - tp)
    curve = matching.pr_sweep(t, p, "mass", (30, 30, 30), 3, 6.0, more_than=5, at=[4.5])
    got = {r.value: (r.n, r.tp, r.fp, r.fn) for r in curve.collect()}
    assert got == want
    best = matching.best_cut(curve).first()
    f1 = {v: 2 * tp / (2 * tp + fp + fn) for v, (_, tp, fp, fn) in want.items()}
    assert best.value == min(v for v in f1 if round(f1[v], 6) == round(max(f1.values()), 6))


def test_sweep_without_rows(spark):
    none = spark.createDataFrame([], "id long, x double, y double, z double, mass double")
    assert matching.pr_sweep(none, none, "mass", (9, 9, 9), 1, 2.0).count() == 0


def test_targets_by_a_plain_filter(spark):
    size, margin = (14, 12, 13), 2
    at = np.array([[5.0, 5, 5], [5.2, 5.4, 4.6], [7, 5, 6], [1, 1, 1], [2, 6, 6], [10.4, 8, 9]])
    m = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "id long, x double, y double, z double")
    v = np.zeros(size)
    for p in at:
        if min(*(p - margin), *(np.array(size) - margin - p)) > 0:
            v[tuple(np.rint(p).astype(int))] = 1
    k = np.exp(-(np.arange(-2, 3) ** 2) / 2)
    for axis in range(3):
        v = np.apply_along_axis(lambda line: np.convolve(line, k, "same"), axis, v)
    v /= v.max()
    got = learning.gaussian_targets(m, size, margin).toPandas()
    assert len(got) == (v > 0).sum() and got.target.to_numpy() == pytest.approx(v[got.x, got.y, got.z]) and got.target.max() == 1.0


def test_pivot_and_transpose(spark):
    log = spark.createDataFrame([(4.5, 5.0, "a", 3, 1, 2), (4.5, 5.0, "b", 5, 1, 0), (6.0, 5.0, "a", 1, 0, 7), (6.0, 5.5, "a", 0, 0, 0)], "r double, R_ double, tile string, tp long, fp long, fn long")
    scores = matching.model_scores(log, "r", "R_")
    assert {(s.r, s.R_): (s.precision, s.recall) for s in scores.collect()} == {(4.5, 5.0): (0.8, 0.8), (6.0, 5.0): (1.0, 0.125), (6.0, 5.5): (1.0, 1.0)}
    wide = matching.model_pivot(scores, "R_", "r", "f1").orderBy("R_").collect()
    assert wide[0].asDict() == {"R_": 5.0, "r=4.5": 0.8, "r=6.0": pytest.approx(0.222222)} and wide[1]["r=4.5"] is None
    flat = matching.model_pivot(scores, "r", "R_", "f1").orderBy("r").collect()
    assert flat[0]["R_=5.0"] == wide[0]["r=4.5"] and flat[1]["R_=5.5"] == wide[1]["r=6.0"]


def test_running_sums(spark):
    r = np.random.default_rng(9)
    n = r.integers(-5, 9, 500)
    df = spark.createDataFrame([(int(k), int(v)) for k, v in enumerate(n)], "k long, v long").repartition(7)
    got = running(df, {"s": "v"}, F.col("k")).orderBy("k").toPandas()
    assert (got.s.to_numpy() == np.cumsum(n)).all()


def test_balance(spark):
    rows = [(k, int(k % 7 == 0), [0.0]) for k in range(300)] + [(None, 0, [1.0])] * 3
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    got = learning.balanced(df, seed=3)
    n = got.groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in n} == {0: 43, 1: 43}
    assert sorted(got.collect(), key=str) == sorted(learning.balanced(df, seed=3).collect(), key=str)


def _walk(pairs, threshold):
    """The greedy walk over ``(a, b, d, v)`` with ``v`` above the threshold."""
    a_used, b_used, out = set(), set(), set()
    for a, b, d, v in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if v > threshold and a not in a_used and b not in b_used:
            a_used.add(a), b_used.add(b), out.add((a, b))
    return out


def test_one_walk_for_all_thresholds(spark, monkeypatch):
    """Pairs picked at every threshold of one large component, with ties of distances and of values; pairs are never matched a threshold each."""
    r = np.random.default_rng(11)
    v = r.integers(0, 40, 60).astype(float)
    pairs = [(int(a), int(b), float(r.integers(1, 12)), float(v[b])) for a, b in {tuple(p) for p in r.integers(0, 60, (500, 2)).tolist()}]
    sizes, cut = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: (lambda out: sizes.append(out.count()) or out)(cut(df)))
    got = matching.lifetimes(spark.createDataFrame(pairs, "a_id long, b_id long, d double, v double")).collect()
    for t in [float("-inf"), *np.unique(v)]:
        assert {(g.a_id, g.b_id) for g in got if g.since <= t < g.until} == _walk(pairs, t)
    assert max(sizes) <= len(pairs)


def test_sweep_with_ids_that_repeat(spark):
    """An id with two attributes is one end of a match, at each threshold for the rows above it."""
    at = lambda k: (100.0 + 3 * k, 100.0, 100.0)
    true = spark.createDataFrame([(k, *at(k)) for k in range(4)], "id long, x double, y double, z double")
    pred = spark.createDataFrame([(0, *at(0), 5.0), (0, *at(1), 9.0), (2, *at(2), 7.0)], "id long, x double, y double, z double, v double")
    got = {p.value: p.tp for p in matching.pr_sweep(true, pred, "v", (400, 400, 400), 10, 4.0, more_than=-1).collect()}
    assert got == {5.0: 2, 7.0: 1, 9.0: 0}
