import pytest

from tests.oracle import same, sql
from voxelspark.llm import line_dedup


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = line_dedup.dedup_lines(docs, counts=True).select("doc_id", "text", "n_lines", "n_removed").toPandas()
    same(got, sql(line_dedup.ORACLE, d))
    assert sf == "sf0.001" or got.n_removed.sum() > 0


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_nulls_and_clashing_columns(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rows = [(k, f"menu\nown {k}\n\n menu ", None, k) for k in range(8)] + [(8, None, "h", 0), (9, "", "h", 0), (10, "menu\nmenu", "h", 0), (11, "menu", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lines long")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert got[3].text == "own 3\n" and (got[3].n_lines, got[3].n_removed) == (4, 2)
    assert got[8].text is None and got[9].text == "" and got[10].text == "menu\nmenu" and got[11].text == ""
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
