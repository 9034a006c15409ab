import hashlib
import random
import re
from collections import Counter

import pytest

from voxelspark.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, window, gram=8, extra=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in S.mark_repeats(df, window=window, gram=gram).collect()), key=repr)


@pytest.mark.parametrize("seed,window,gram", [(0, 5, 3), (1, 4, 4), (2, 6, 2), (3, 1, 8)])
def test_brute_force(spark, seed, window, gram):
    r = random.Random(seed)
    rows = [(r.choice([k, k, None]), " ".join(r.choice("a b c dd é".split()) for _ in range(r.choice([0, 3, 8, 40])))) for k in range(25)]
    rows += [(90, None), (91, ""), (92, " \t\n"), (93, "x y " * 30), (94, "x y " * 30), (94, "unique words only here now")]
    assert run(spark, rows, window, gram) == brute(rows, window)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((tuple(r) for r in S.mark_repeats(docs).collect()), key=repr)
    assert got == brute(rows, 35) and sum(r[2] for r in got) > 1000


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    import numpy as np

    h, row = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64), np.repeat([0, 1, 2], [200, 20, 180])
    small = S.anchors(h, row, 35, 8)
    monkeypatch.setattr(S, "BLOCK", 1 << 20)
    large = S.anchors(h, row, 35, 8)
    assert all((a == b).all() for a, b in zip(small, large, strict=True))


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, digest long")
    assert S.mark_repeats(df.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in S.mark_repeats(df, with_text=True).collect()] == [(1, 2, 0)]
