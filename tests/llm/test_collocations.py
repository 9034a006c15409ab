import re
from collections import Counter

import numpy as np
import pytest

from tests.oracle import same, sql
from voxelspark.llm import collocations as co
from voxelspark.llm.registry import QUERIES

AZ = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count, max_words=5, top=2000, percent=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    many = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    out = {}
    for (lang, w), a in many.items():
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(v[i : i + len(w)] == w and 100 * b >= percent * a for (other, v), b in many.items() if other == lang and len(v) > len(w) for i in range(len(v) - len(w) + 1))
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, total, -s) for lang, found in out.items() for i, (s, a, p, left, r, total) in enumerate(sorted(found)[:top]))


def of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    got = QUERIES["op12_phrase_collocations"](spark, d)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    same(got.toPandas(), sql(co.ORACLE, d))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = ["New", "york", "city", "the", "of", "a", "é", "x" * 300, "Σ", "b-c"]
    out = []
    for k in range(400):
        text = "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b", " "], p=[0.6, 0.1, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])) for _ in range(rng.integers(0, 60)))
        out.append((["en", "de", None, "und", ""][k % 5], text + " new York City" * (k % 3)))
    return [*out, ("en", None), ("fr", ""), (None, "  \n")]


def test_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, lang, t, 1, "x") for i, (lang, t) in enumerate(rows)], "n long, lang string, text string, f int, phrase string")
    for options in ({"min_count": 10}, {"min_count": 3, "top": 25, "percent": 80}, {"min_count": 5, "max_words": 3}):
        assert of(co.mine(docs, **options)) == brute(rows, **options)


def test_slices_and_full_sketches_lose_nothing(spark, rows, monkeypatch):
    """Many slices, small buffers, and a sketch so loaded that it lets everything through."""
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute(rows, 10)
    monkeypatch.setattr(co, "BUFFER", 500)
    assert of(co.mine(docs, min_count=10)) == want
    monkeypatch.setattr(co.Shape, "__init__", lambda self, items, min_count: self.__dict__.update(log2=20, slices=4, part=18))
    assert of(co.mine(docs, min_count=10)) == want
    monkeypatch.setattr(co.Shape, "place", lambda self, keys, row: keys & np.uint64(3))
    assert of(co.mine(docs, min_count=10)) == want


def test_shape_grows_without_a_cap():
    small, large = co.Shape(10**6, 100), co.Shape(10**12, 100)
    assert small.slices == 1 and 1 << large.log2 >= 4 * 10**12 / 100 and large.slices > 1
    assert co.DEPTH << large.part <= 8 * co.SLICE_BYTES
    keys = np.arange(10**5, dtype=np.uint64)
    large.log2, large.slices, large.part = 24, 8, 21
    for row in range(co.DEPTH):
        assert ((large.cells(keys, row) >> np.uint64(21)) == large.slice_of(keys)).all() and large.cells(keys, row).max() < 1 << 24


def test_the_sketch_drops_rare_phrases(spark, small):
    """Of the phrases that the second reading gets, few are below the threshold."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("lang", "text")
    shape = co.Shape(rows.count() * 400 * 5, 100)
    chunks = [(r[0], bytes(r[1])) for r in co.sketch(rows, shape, 100, 5).collect()]
    left = co._survivors(rows, shape, 0, chunks, 5).groupBy("lang", "phrase").sum("n").toPandas()
    frequent = left[left["sum(n)"] >= 100]
    assert len(frequent) > 50 and len(left) < 1.5 * len(frequent) + 100


def test_products_beyond_64_bits(spark):
    big = 10**12
    counts = spark.createDataFrame([("en", "", big * 1000), ("en", "a", big), ("en", "b", big), ("en", "a b", big - 7)], "lang string, phrase string, f long")
    got = co.scored(counts).collect()[0]
    assert got.score == 1000 * (big - 7) * big * 1000 // (big * big)


def test_empty_and_long(spark):
    docs = spark.createDataFrame([("en", "the end " * 150_000)], "lang string, text string")
    assert of(co.mine(docs)) == brute([("en", "the end " * 150_000)], 100)
    assert co.mine(docs.limit(0)).count() == 0
