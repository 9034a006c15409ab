import numpy as np
import pytest

from voxelspark.llm import whitening
from voxelspark.llm.registry import QUERIES


def exact(vectors):
    """(x, n, sums, deviations) in whole numbers."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64).astype(object) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    return x, n, sums, [int(sum((n * r - sums) ** 2)) for r in x]


def check(got, ids, vectors, components=32):
    x, n, sums, deviations = exact(vectors)
    x = np.array(x, np.float64)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == len(ids) * k and set(got.n) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign((wide * want).sum(axis=0))
    assert wide == pytest.approx(want * signs, abs=1e-6)
    first = got[got.component == 1].set_index("vec_id").loc[ids]
    assert [int(v) for v in first.deviation] == deviations
    explained = got.groupby("component").explained.first().to_numpy()
    assert explained == pytest.approx(values[:k] / values.sum(), rel=1e-9)
    cov = np.cov(wide.T, bias=True).reshape(k, k)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] == pytest.approx(np.abs(cov - np.eye(k)).max(), abs=1e-9) and got.identity_error.iloc[0] < 1e-6


def test_query(spark, small):
    src = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    got = QUERIES["op13_embedding_whitening"](spark, small)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    usable = [v is not None and all(c is not None and np.isfinite(c) for c in v) for v in src.embedding]
    src = src[usable]
    check(got.toPandas(), src.vec_id.tolist(), src.embedding.tolist())


def test_nulls_lengths_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(40)]
    other = [(100 + k, rng.normal(size=2).tolist()) for k in range(9)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [])]
    df = spark.createDataFrame([(i, v, 1, [0]) for i, v in rows + other + bad + [(300, [0.0] * 5)]], "vec_id long, embedding array<double>, n int, x array<int>")
    got = whitening.whiten(df).toPandas()
    assert set(got.vec_id) == {i for i, _ in rows + other} | {300}
    check(got[~got.vec_id.between(100, 110)], [i for i, _ in rows] + [300], [v for _, v in rows] + [[0.0] * 5])
    check(got[got.vec_id.between(100, 110)], [i for i, _ in other], [v for _, v in other])
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.limit(0)).columns == whitening.whiten(df).columns


def test_rank_and_huge_entries(spark):
    """Rows on a line have one component; equal rows none; entries beyond whole numbers don't crash."""
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 3.0]) for k in range(20)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).toPandas()
    check(got, list(range(20)), [[float(k), 2.0 * k, 3.0] for k in range(20)])
    assert set(got.component) == {1}
    same = spark.createDataFrame([(k, [0.1, 0.2]) for k in range(7)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (None, [1.0, -1e300]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(huge).collect()) > 0


def test_more_dimensions_than_rows(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(12, 50))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).toPandas()
    check(got, list(range(12)), vectors.astype(np.float32).astype(np.float64).tolist())
    assert got.component.max() == 11
