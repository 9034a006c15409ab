import numpy as np
import pytest

from voxelspark.llm import nearest as N


def brute(ids, x, every=20, k=20):
    out = {}
    for i in np.flatnonzero(np.array(ids) % every == 0):
        score = N.exact(x[i], x)
        other = [j for j in range(len(ids)) if ids[j] != ids[i]]
        out[ids[i]] = [(ids[j], score[j]) for j in sorted(other, key=lambda j: (-score[j], ids[j]))[:k]]
    return out


def found(spark, ids, x, **options):
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int")
    out = {}
    for r in sorted(N.search(df, **options).collect()):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(df.embedding.tolist()).astype(np.float64), df.vec_id.tolist()
    got, want = found(spark, ids, x), brute(ids, x)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        truth = dict(want[q])
        assert all(truth.get(a, s) == s for a, s in rows)


@pytest.mark.parametrize("points,queries", [(4096, 1024), (7, 3)])
def test_everything_probed_is_exact(spark, monkeypatch, points, queries):
    monkeypatch.setattr(N, "POINTS", points)
    monkeypatch.setattr(N, "QUERIES", queries)
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 5)).astype(np.float32).astype(np.float64) * r.choice([0.2, 1, 3], (120, 1))
    x = x.astype(np.float32).astype(np.float64)
    x[60:100] = x[3]  # one vector held by a third of all rows
    ids = r.permutation(400)[:120].tolist()
    assert found(spark, ids, x, success=0.99999, every=4, k=5) == brute(ids, x, 4, 5)


def test_ties(spark):
    """Few distinct scores, many ties at the cut: the smaller id decides."""
    r = np.random.default_rng(5)
    x = r.integers(-1, 2, (260, 6)).astype(np.float64)
    x[(x == 0).all(axis=1), 0] = 1.0
    ids = r.permutation(1000)[:260].tolist()
    for success in (0.62, 0.99999):
        got = found(spark, ids, x, every=7, k=5, success=success)
        assert all(rows == sorted(rows, key=lambda r: (-r[1], r[0])) for rows in got.values())
    assert got == brute(ids, x, 7, 5)


def test_best_of_tied_scores():
    r = np.random.default_rng(6)
    for _ in range(20):
        import pyarrow as pa

        x, p = r.integers(0, 2, (200, 4)).astype(float), r.permutation(500)[:200]
        points = pa.table({"p": p, "vector": pa.array(x.tolist())})
        got = N._best(7)(points, pa.table({"q": [1], "vector": [[1.0, 1.0, 0.0, 0.0]]}))
        want = sorted(range(200), key=lambda i: (-(x[i, 0] + x[i, 1]), p[i]))[:7]
        assert got["p"].to_pylist() == [p[i] for i in want]


@pytest.mark.parametrize("projections", [4, 6])
def test_recall_with_more_projections(spark, projections):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x, ids = np.array(df.embedding.tolist()).astype(np.float64), df.vec_id.tolist()
    got, want = found(spark, ids, x, projections=projections), brute(ids, x)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert [N.projections_for(n) for n in (0, 1, 100_000, 100_001, 10**6, 10**9)] == [3, 3, 3, 4, 6, 12]


def test_lengths_apart(spark):
    r = np.random.default_rng(7)
    rows = [(k, r.normal(size=3 if k % 3 else 2).round(2).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for q in N.search(df, every=4, k=4, success=0.99999).collect():
        got.setdefault(q.query_id, []).append(q.vec_id)
    for q, v in rows:
        if q % 4 == 0:
            others = [(float(N.exact(np.array(v), np.array([w]))[0]), i) for i, w in rows if i != q and len(w) == len(v)]
            others.sort(key=lambda x: (-x[0], x[1]))
            assert sorted(got[q]) == sorted(i for _, i in others[:4])


def test_few_and_odd_rows(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, 1.0]), (40, None), (60, [nan, 1.0]), (80, [0.0, 0.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (3, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, q long")
    assert [tuple(r) for r in N.search(df).orderBy("query_id", "rank").collect()] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert N.search(df.limit(0)).count() == 0
