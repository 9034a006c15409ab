"""Phrase collocation mining: counted phrases of a few words, scored by their weakest cut, without parts of larger ones.

Method: two readings around a count-min sketch. The first counts every phrase of one to ``max_words`` words in ``DEPTH``
rows of cells, summed in each task and merged over all tasks; a cell's sum is at least the count of any phrase in it, so
a phrase with a cell below ``min_count`` can't be frequent. The second reading aggregates the phrases that are left by
their own words, exactly, and drops those that the estimate let through; nothing frequent is lost. A frequent phrase's
parts are at least as frequent, so all counts that the scores need are among the survivors.

The sketch has as many cells as keep their mean load at a quarter of ``min_count``, whatever the input's size. No task
holds it whole: tasks send sparse sums by ``CHUNK`` of cells, which are merged chunk by chunk; what goes to all tasks of
the second reading is one bit a cell. Where these bits exceed ``SLICE_BYTES``, phrases are dealt to slices by their hash
and the second reading is made once a slice, so the memory has a bound and the filter stays as sharp.

Phrases of a batch are told apart by 64-bit hashes of their words before they are counted by their words; with a million
distinct phrases in a batch two of them share a hash with a probability of 3e-8.

Defined results: a null text counts as empty, a null language as ``und``; only A to Z are lower-cased; phrases don't cross
the signs in ``BREAKS``, nor rows; repeated rows count each; ids don't matter, extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.functions.numbering import numbered
from voxelspark.llm.arrays import Words, grams, mix, pieces, text_bytes
from voxelspark.llm.hot import join_hot
from voxelspark.llm.storage import cut, table
from voxelspark.llm.workers import release, text_batches, tidy

#: The signs that end a piece, and the bytes that part words within one.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
MIN_COUNT, MAX_WORDS, TOP, PERCENT = 100, 5, 2000, 100
DEPTH, CHUNK_BITS, MIN_LOG2 = 2, 18, 18
CHUNK = 1 << CHUNK_BITS
#: Bits of one slice that a task of the second reading holds, in bytes.
SLICE_BYTES = 64 << 20
#: Keys that a task sums before it sends them; bytes of text handled at once.
BUFFER, PIECE = 1 << 22, 1 << 21
#: Parts in which a language's phrases are ranked before their best are ranked together.
PARTS = 64
_IS_BREAK, _IS_SEP = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True
_IS_SEP[list(BREAKS + BLANKS)] = True


class Phrases:
    """Words of a stretch of a batch, and the keys of the phrases that start at each."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, first: int, last: int):
        data, offsets = text_bytes(texts.slice(first, last - first))
        self.words = w = Words(data, offsets, lower=True, separators=_IS_SEP)
        breaks = np.cumsum(_IS_BREAK[w.data], dtype=np.int64)
        # both grow along the text, so the sum is equal only where both are
        self.piece = breaks[w.start] + w.row if len(w.start) else w.row
        self.lang = langs[first:last][w.row]
        self.hashes = w.hashes()

    def keys(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(places where a phrase of ``m`` words starts, the phrase's key with its language)."""
        n = len(self.piece) - m + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[m - 1 :])
        return at, mix(grams(self.hashes, m)[at] ^ self.lang[at], m)

    def phrase(self, at: int, m: int) -> bytes:
        w = self.words
        return b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(at, at + m))


def _langs(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct languages, the place of each row's among them, its hash)."""
    coded = column.fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    which = np.asarray(coded.indices)
    hashes = np.array([int.from_bytes(zlib.crc32(x.encode()).to_bytes(4, "big") + zlib.adler32(x.encode()).to_bytes(4, "big"), "big") for x in names], np.uint64)
    return names, which, mix(hashes, 77)[which] if names else np.zeros(0, np.uint64)


class Shape:
    """Width of the sketch: ``2**log2`` cells a row in ``slices`` equal parts, each for the keys of its own."""

    def __init__(self, items: int, min_count: int):
        self.log2 = max(MIN_LOG2, math.ceil(math.log2(max(1.0, 4 * items / min_count))))
        self.slices = 1
        while DEPTH << self.log2 > 8 * SLICE_BYTES * self.slices and self.slices < 1 << (self.log2 - CHUNK_BITS):
            self.slices *= 2
        self.part = self.log2 - (self.slices - 1).bit_length()

    def slice_of(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys, 200) & np.uint64(self.slices - 1)

    def place(self, keys: np.ndarray, row: int) -> np.ndarray:
        """The cell within the key's slice."""
        return mix(keys, 201 + row) >> np.uint64(64 - self.part)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (self.slice_of(keys) << np.uint64(self.part)) | self.place(keys, row)


def _sums(keys: np.ndarray, shape: Shape) -> Iterator[pa.RecordBatch]:
    """The sums of a buffer by chunk: distinct cells as steps, and their counts."""
    for row in range(DEPTH):
        cells, counts = np.unique(shape.cells(keys, row), return_counts=True)
        chunk = (cells >> np.uint64(CHUNK_BITS)).astype(np.int64)
        bounds = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
        out = {"chunk": [], "cells": [], "counts": []}
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            inside = (cells[a:b] & np.uint64(CHUNK - 1)).astype(np.int32)
            out["chunk"].append(row << (shape.log2 - CHUNK_BITS) | int(chunk[a]))
            out["cells"].append(zlib.compress(np.diff(inside, prepend=0).astype(np.int32).tobytes(), 1))
            out["counts"].append(zlib.compress(counts[a:b].astype(np.int32).tobytes(), 1))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(out["chunk"], pa.int64()), "cells": pa.array(out["cells"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})


def _merge(min_count: int):
    """Sum the chunks, which arrive in order; of each, one bit a cell: whether its sum reaches ``min_count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(CHUNK, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(sums >= min_count).tobytes(), 1)], pa.binary())})

        for batch in batches:
            for k, cells, counts in zip(batch["chunk"].to_pylist(), batch["cells"], batch["counts"], strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at = k
                    sums[:] = 0
                sums[np.cumsum(np.frombuffer(zlib.decompress(cells.as_py()), np.int32))] += np.frombuffer(zlib.decompress(counts.as_py()), np.int32)
        if at is not None:
            yield done()

    return run


class Filter:
    """The bits of one slice: which of its cells reach the threshold, in each row of the sketch."""

    def __init__(self, shape: Shape, number: int, chunks: list[tuple[int, bytes]]):
        self.shape, self.number = shape, number
        self.bits = np.zeros((DEPTH, 1 << (shape.part - 3)), np.uint8)
        for k, packed in chunks:
            row, at = k >> (shape.log2 - CHUNK_BITS), (k & ((1 << (shape.part - CHUNK_BITS)) - 1)) * (CHUNK >> 3)
            self.bits[row, at : at + (CHUNK >> 3)] = np.frombuffer(zlib.decompress(packed), np.uint8)

    def may_be(self, keys: np.ndarray) -> np.ndarray:
        """Whether a key is of this slice and its estimate reaches the threshold."""
        out = self.shape.slice_of(keys) == np.uint64(self.number)
        for row in range(DEPTH):
            cells = self.shape.place(keys[out], row)
            out[out] = (self.bits[row][(cells >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return out


def sketch(rows: DataFrame, shape: Shape, min_count: int, max_words: int) -> DataFrame:
    """``chunk, bits``: the merged count-min sketch of all phrases of ``rows(lang, text)``, one bit a cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            _, _, langs = _langs(batch.column(0))
            for first, last in pieces(batch.column(1), PIECE):
                found = Phrases(batch.column(1), langs, first, last)
                for m in range(1, max_words + 1):
                    held.append(found.keys(m)[1])
                    n += len(held[-1])
                if n >= BUFFER:
                    yield from _sums(np.concatenate(held), shape)
                    held, n = [], 0
        if n:
            yield from _sums(np.concatenate(held), shape)

    sums = rows.mapInArrow(tidy(partial), "chunk long, cells binary, counts binary")
    chunks = DEPTH << (shape.log2 - CHUNK_BITS)
    return table(sums.repartition(max(1, min(chunks, 4096)), "chunk").sortWithinPartitions("chunk").mapInArrow(tidy(_merge(min_count)), "chunk long, bits binary"), "collocation-sketch")


def _survivors(rows: DataFrame, shape: Shape, number: int, chunks: list[tuple[int, bytes]], max_words: int) -> DataFrame:
    """``lang, phrase, n`` of the phrases of one slice that may be frequent, summed by stretch; with slice 0 all words as the phrase ''."""
    shared = rows.sparkSession.sparkContext.broadcast((shape, number, chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*shared.value)
        for batch in batches:
            names, which, langs = _langs(batch.column(0))
            for first, last in pieces(batch.column(1), PIECE):
                found = Phrases(batch.column(1), langs, first, last)
                of = which[first:last][found.words.row]
                lang, phrase, count = [], [], []
                if number == 0:
                    for k, n in enumerate(np.bincount(of, minlength=len(names)).tolist()):
                        lang.append(k), phrase.append(b""), count.append(n)
                for m in range(1, max_words + 1):
                    at, keys = found.keys(m)
                    kept = known.may_be(keys)
                    _, one, n = np.unique(keys[kept], return_index=True, return_counts=True)
                    at = at[kept][one]
                    lang += of[at].tolist()
                    phrase += [found.phrase(i, m) for i in at.tolist()]
                    count += n.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang, pa.int32())), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "phrase", "n"])

    return rows.mapInArrow(tidy(run), "lang string, phrase string, n long")


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, phrase, f``: every phrase of up to ``max_words`` words with at least ``min_count`` occurrences, and all words of a language as ``''``."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    # a word and its blank take two bytes at least, six as a rule; the sketch's load is what depends on it, not the result
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = Shape(n_bytes // 6 * max_words, min_count)
    bits = sketch(rows, shape, min_count, max_words)
    parts = []
    for number in range(shape.slices):
        of_slice = F.shiftright("chunk", shape.part - CHUNK_BITS).bitwiseAND(F.lit(shape.slices - 1)) == number
        chunks = [(r[0], bytes(r[1])) for r in bits.where(of_slice).collect()]
        grouped = _survivors(rows, shape, number, chunks, max_words).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        parts.append(table(grouped.where((F.col("f") >= min_count) | (F.col("phrase") == "")), "collocation-counts"))
        del chunks
    release()
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _decimal(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of every phrase of two words and more: its weakest cut, the first of equals."""
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    parts = counts.where("phrase <> ''").select("lang", "phrase", "f")
    w, n = F.col("w"), F.size("w")
    many = parts.withColumn("w", F.split("phrase", " ")).where(n > 1).select("lang", "phrase", F.col("f").alias("a"), "w")
    join = lambda first, length: F.array_join(F.slice(w, first, length), " ")
    cut = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(k.alias("k"), join(F.lit(1), k).alias("first"), join(k + 1, n - k).alias("rest")))
    cuts = many.select("lang", "phrase", "a", n.alias("words"), F.explode(cut).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "words", "cut.*")
    both = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # a language may hold most phrases
    sizes = parts.groupBy("lang").agg(F.count(F.lit(1)).alias("phrases"))
    both = join_hot(both, totals.join(sizes, "lang"), ["lang"], "phrases", parts.count())
    # 38 digits: a and n are below 10**17 each
    top, bottom = _decimal(_decimal("a") * _decimal("n")) * F.lit(1000).cast("decimal(4,0)"), _decimal("l") * _decimal("r")
    both = both.withColumn("top", _decimal(top)).withColumn("bottom", _decimal(bottom)).withColumn("score", F.expr("top div bottom"))
    least = both.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def subsumed(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``found`` without phrases inside a longer one that has ``percent`` of their count.

    It is enough to look one word further: whatever is longer holds a phrase that is, at least as often.
    """
    words = F.split("phrase", " ")
    n = F.size("w")
    sub = F.array(F.array_join(F.slice("w", F.lit(1), n - 1), " "), F.array_join(F.slice("w", F.lit(2), n - 1), " "))
    inside = found.where("words > 2").select("lang", "a", words.alias("w")).select("lang", F.col("a").alias("longer"), F.explode(sub).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language.

    Parts of a language are ranked first, so no task ranks a whole one; what is left of all is numbered by ranges, and a
    language's ranks begin where its numbers do.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    placed = cut(numbered(few.drop("part", "rank"), F.col("lang"), *order))
    starts = placed.groupBy("lang").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("phrases"))
    ranked = join_hot(placed, starts, ["lang"], "phrases", placed.count()).withColumn("rank", F.col("number") - F.col("start") + 1)
    return ranked.where(F.col("rank") <= top).drop("number", "start")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    found = table(scored(counted(docs, text_col, lang_col, min_count, max_words)), "collocations")
    return best(subsumed(found, percent), top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
             string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^ 	]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.*, x.f AS l, y.f AS r, n.n, CAST(CAST(1000 AS HUGEINT) * k.a * n.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM k JOIN n ON k.lang = n.lang
      JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.phrase = list_aggregate(k.w[1:k.k], 'string_agg', ' ')
      JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.phrase = list_aggregate(k.w[k.k + 1:], 'string_agg', ' ')),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
longer AS (SELECT lang, list_aggregate(w[i:i + j - 1], 'string_agg', ' ') AS phrase, max(a) AS a
      FROM (SELECT lang, w, a, j, unnest(range(1, m - j + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS j) WHERE j < m) GROUP BY ALL),
q AS (SELECT o.* FROM o LEFT JOIN longer x ON x.lang = o.lang AND x.phrase = o.phrase WHERE nth = 1 AND (x.a IS NULL OR 100 * x.a < 100 * o.a)),
z AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM q)
SELECT * FROM z WHERE rank <= 2000
"""
