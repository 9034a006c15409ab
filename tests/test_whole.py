"""Queries over all voxels and all markers: against their SQL with its cut taken out, or against numpy."""

import numpy as np
import pytest

from tests.oracle import same, sql
from voxelspark.operators import shape
from voxelspark.plans import catalog
from voxelspark.plans.fixtures import view

CORNER = "x < 16 AND y < 16 AND z < 16"
#: What the SQL of a query is without its cut: texts and what stands in their place.
VOXELS = {
    **{n: {f" WHERE {CORNER}": ""} for n in ("ball_convolution", "soft_convolution", "regional_maxima", "local_entropy", "content_fusion", "patch_labels")},
    "negative_sites": {"v.x < 16 AND v.y < 16 AND v.z < 16 AND ": ""},
    "resample_nn": {"x FROM range(16)": "x FROM range(64)", "y FROM range(16)": "y FROM range(64)", "z FROM range(16)": "z FROM range(32)"},
}
MARKERS = {
    **{n: {" WHERE id <= 40": ""} for n in ("patch_extract", "standardize", "patch_standardized", "local_standardize", "overlap_add", "overlap_normalize")},
    "positive_sites": {" AND id <= 200": ""},
    "cluster_radius": {"CROSS JOIN (SELECT * FROM markers_true WHERE id <= 50) a": "CROSS JOIN markers_true a"},
    "visible_pairs": {" WHERE id <= 100": ""},
}
#: More markers than any of the cuts let through.
MORE = "/root/testdata/sf0.01"


def whole(name, cuts):
    text = catalog.ORACLE[name]
    for old, new in cuts.items():
        # the SQL may be written whole one day
        assert old in text or new in text
        text = text.replace(old, new)
    return text


@pytest.mark.parametrize("name", sorted(VOXELS))
def test_all_voxels(spark, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    assert got.x.max() > 16 and got.y.max() > 16 and got.z.max() > 16
    same(got, sql(whole(name, VOXELS[name]), small))


def test_deconvolve_whole_volume(spark, small):
    size, sigma, reach = catalog.VOLUME, 2 / 3, 2
    # one voxel more below, where the patches of the first sites reach, and nothing beyond
    v = np.zeros([n + 2 * reach for n in size])
    for r in view(spark, small, "voxels").collect():
        v[r.x + reach, r.y + reach, r.z + reach] = r.intensity / 255
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    for axis in range(3):
        v = np.apply_along_axis(lambda line: np.convolve(line, k / k.sum(), "valid"), axis, v)
    want = np.minimum(255, np.floor(np.round(v * 255, 6)))
    got = catalog.QUERIES["deconvolve_identity"](spark, small).toPandas()
    assert len(got) == np.prod(size)
    assert (got.intensity.to_numpy() == want[got.x, got.y, got.z]).all()


@pytest.mark.parametrize("name", sorted(MARKERS))
def test_all_markers(spark, name):
    same(catalog.QUERIES[name](spark, MORE).toPandas(), sql(whole(name, MARKERS[name]), MORE))


def points(spark, d, name="markers_true"):
    df = view(spark, d, name).orderBy("id").toPandas()
    return df.id.to_numpy(), df[["x", "y", "z"]].to_numpy(float)


def nearest_others(ids, x, k):
    """Distances, and the ``k`` nearest others of each point (ties: the smaller id) as positions."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, axis=1, kind="stable")[:, :k]


def test_shares_of_all_clusters(spark, small):
    ids, x = points(spark, small)
    _, p = points(spark, small, "markers_pred")
    own = ids[np.argmin(((p[:, None] - x[None]) ** 2).sum(axis=2), axis=1)]
    got = catalog.QUERIES["cluster_shares"](spark, small).toPandas()
    assert dict(zip(got.cluster, got.n, strict=True)) == dict(zip(*np.unique(own, return_counts=True), strict=True))


def test_all_landmarks(spark, monkeypatch):
    seen, fit = [], shape.ransac
    monkeypatch.setattr(shape, "ransac", lambda pairs, **more: seen.append(pairs.count()) or fit(pairs, **more))
    got = catalog.QUERIES["rigid_from_landmarks"](spark, MORE).toPandas()
    assert seen == [view(spark, MORE, "markers_true").count()]
    same(got, sql(catalog.ORACLE["rigid_from_landmarks"], MORE))


def pieces(n, near):
    label = np.arange(n)
    while True:
        new = label.copy()
        for k in range(near.shape[1]):
            np.minimum.at(new, near[:, k], label)
            np.minimum(new, new[near[:, k]], out=new)
        if (new == label).all():
            return len(set(label))
        label = new


def test_connected_k_of_all_markers(spark):
    ids, x = points(spark, MORE)
    _, near = nearest_others(ids, x, 64)
    want = next(k for k in range(1, 65) if pieces(len(x), near[:, :k]) == 1)
    assert want != next(k for k in range(1, 65) if pieces(201, nearest_others(ids[:201], x[:201], 64)[1][:, :k]) == 1)
    assert catalog.QUERIES["min_connected_k"](spark, MORE).first().k == want


def test_patches_from_all_markers(spark, small):
    ids, x = points(spark, small)
    d, near = nearest_others(ids, x, 6)
    g = np.full(d.shape, np.inf)
    np.fill_diagonal(g, 0)
    for i in range(len(x)):
        g[i, near[i]] = d[i, near[i]]
    for k in range(len(x)):
        g = np.minimum(g, g[:, k : k + 1] + g[k : k + 1])
    got = {(r.seed, r.id): r.d for r in catalog.QUERIES["geodesic_patch"](spark, small).collect()}
    assert got == pytest.approx({(ids[i], ids[j]): g[i, j] for i, j in np.argwhere(g <= 60)}, abs=1e-6)
    least = {}
    for row in g <= 60:
        some = np.flatnonzero(row)
        if len(some) >= 3:
            y = x[some]
            off = np.sqrt(((shape.lowess(shape.isomap(y, min(6, len(y) - 1)), y, 30.0) - y) ** 2).sum(axis=1))
            for i, v in zip(ids[some], off, strict=True):
                least[i] = min(v, least.get(i, np.inf))
    got = {r.id: r.distance for r in catalog.QUERIES["manifold_filter"](spark, small).collect()}
    assert len(got) > len(x) / 2 and got == pytest.approx(least, abs=1e-3)


def test_connected_k_beyond_the_first_guess(spark):
    rows = [(i, float(i % 6 + 1000 * (i // 6)), 0.0, 0.0) for i in range(12)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    # five others in a cluster, so the sixth is the first in the other one
    assert shape.smallest_connected_k(p, 64.0, 2) == 6
