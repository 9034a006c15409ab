import pytest

from tests.oracle import same, sql
from voxelspark.llm import mixing


def fill(sizes, weights, epochs=3):
    """Clamp and reshare, step by step."""
    total, target, fixed = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left, w = total - sum(epochs * sizes[i] for i in fixed), sum(weights[i] for i in range(len(sizes)) if i not in fixed)
        target = [epochs * sizes[i] if i in fixed else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if target[i] > epochs * sizes[i] + 1e-9}
        if not over:
            return target
        fixed |= over


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    same(mixing.takings(docs).toPandas(), sql(mixing.ORACLE, d))


def test_levels_are_the_same_plan(spark, monkeypatch):
    """However few rows a bucket may hold, the thresholds are those of the SQL."""
    d = "/root/testdata/sf0.01"
    monkeypatch.setattr(mixing, "FEW", 2)
    same(mixing.takings(spark.read.parquet(f"{d}/documents.parquet")).toPandas(), sql(mixing.ORACLE, d))


def test_one_giant_document(spark):
    rows = [(1, "w " * 200_000, "a")] + [(k, "w " * 10, "b") for k in range(2, 30)] + [(k, "w " * 7, None) for k in range(30, 50)]
    got = mixing.takings(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = {r.doc_id: r for r in got.itertuples()}
    assert by[1].taken in (0, 200_000) and (got.taken <= 3 * got["size"]).all()
    # the small sources are taken as often as is allowed
    assert all(by[k].taken == 3 * (10 if k < 30 else 7) for k in range(2, 50))


def test_targets_and_takings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.takings(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    want = fill(by["size"].tolist(), [1 + i % 3 for i in range(len(by))])
    assert by.target.tolist() == pytest.approx(want)
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 50).all()
    assert (got.taken <= 3 * got["size"]).all()
    drawn = mixing.draw(docs).groupBy("doc_id").count().toPandas().merge(got, on="doc_id", how="right").fillna(0)
    assert (drawn["count"] * drawn["size"] == drawn.taken).all()


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (None, "q", None, 1), (2, None, "y", 1), (3, "  ", "y", 1), (4, "w " * 50, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.takings(docs).toPandas()
    assert len(got) == 6 and got.target.groupby(got.source_size).first().sum() == pytest.approx(57)
    assert mixing.draw(docs).columns == docs.columns
    assert mixing.takings(docs.limit(0)).count() == 0 and mixing.draw(docs.limit(0)).count() == 0
