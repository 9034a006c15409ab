import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import fingerprints as fp
from voxelspark.llm.registry import QUERIES


def weights(text):
    return {w: math.sqrt(n) for w, n in Counter(w for w in re.split(fp.SPACE, text.lower()) if w).items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    union = sum(max(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys())
    return sum(min(a[w], b[w]) for w in a.keys() & b.keys()) / union if union else 1.0


def in_order(rows):
    """Rows with id going down, nulls last; texts of one id aren't ordered here."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def edited(text, after):
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 20_000])
def test_against_brute_force(spark, small, bucket_bytes):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = in_order((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fp.edited_likeness(docs, bucket_bytes=bucket_bytes).collect()}
    assert len(got) == len(rows)
    off = {"near_edited": [], "near_next": []}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        new, r = edited(text, after[1]), got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        halves = lambda x: [x[j : j + 8] for j in range(0, len(x), 8)]
        same = lambda a, b: np.mean([x == y for x, y in zip(halves(a), halves(b), strict=True)])
        assert r.near_edited == pytest.approx(same(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(same(r.fingerprint, got[after[0]].fingerprint))
        off["near_edited"].append(r.near_edited - jaccard(text, new))
        off["near_next"].append(r.near_next - jaccard(text, after[1]))
    for wrong in off.values():
        # unbiased, and no further off than so many samples are
        assert abs(np.mean(wrong)) < 4 * 0.5 / math.sqrt(fp.SAMPLES * len(rows)) and np.std(wrong) < 0.6 / math.sqrt(fp.SAMPLES)


def test_collision_rate_is_generalised_jaccard(spark):
    """Many samples of texts whose words differ in weight only."""
    texts = ["a a a a b b c d e e e e e e e e e", "a b b b b c c c c c c c c c x y", "a a a a b b c d e e e e e e e e e f", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many = {}
    for first in range(5):  # samples are told apart by the words' salt
        salted = docs.withColumn("text", F.expr(f"array_join(transform(split(text, ' '), w -> concat(w, '~{first}')), ' ')"))
        for r in fp.signatures(salted, samples=100).collect():
            many.setdefault(r.doc_id, []).extend(r.signature)
    for i in range(len(texts)):
        for j in range(i):
            rate = np.mean(np.array(many[i]) == np.array(many[j]))
            assert rate == pytest.approx(jaccard(texts[i], texts[j]), abs=0.08)


def test_edges(spark):
    long = "word " * 300_000
    rows = [(1, ""), (2, None), (3, "  \n\t "), (None, "no id"), (4, "x" * 50_000), (5, long), (6, "ÀÉ\U0001f600 z"), (7, "ab"), (8, "one two three")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bucket int, word string")
    got = {r.doc_id: r for r in fp.edited_likeness(docs).collect()}
    ordered = in_order((i, t or "") for i, t in rows)
    for k, (i, text) in enumerate(ordered):
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited(text, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint and got[3].near_next == got[2].near_next == 1.0
    assert got[1].near_next == 0.0  # followed by the row without an id
    assert fp.edited_likeness(docs.limit(0)).count() == 0 and fp.edited_likeness(docs.limit(0)).columns == fp.edited_likeness(docs).columns
    alone = fp.edited_likeness(docs.where("doc_id = 8")).collect()
    assert alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"one two tone ").hexdigest()


def test_many_copies_of_one_row(spark):
    """A third of all rows are one row; each but the last is followed by its like."""
    rows = [(5, "the same text here")] * 400 + [(k, f"text number {k} of many") for k in range(6, 800)] + [(1, "last of all words")]
    got = fp.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    mine = got[got.doc_id == 5]
    assert len(got) == len(rows) and len(mine) == 400
    like = hashlib.sha256(edited(rows[0][1], rows[0][1]).encode()).hexdigest()
    last = hashlib.sha256(edited(rows[0][1], rows[-1][1]).encode()).hexdigest()
    assert sorted(mine.edited_sha256.value_counts().to_dict().items()) == sorted({like: 399, last: 1}.items())
    assert (mine.near_next == 1.0).sum() == 399 and mine.fingerprint.nunique() == 1


def test_query(spark, small):
    got = QUERIES["op11_fingerprints"](spark, small)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert got.where("near_edited <= near_next").count() < 0.02 * got.count()
