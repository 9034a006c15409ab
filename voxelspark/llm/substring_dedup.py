"""Substring dedup: words covered by a window of words that also starts somewhere else are removed.

Method: count-min prefilter. Every window of ``window`` words is counted under its anchor, the leftmost
least-hashed run of ``GRAM`` words inside it; equal windows at different places have anchors at different
places, so the sketch of anchors, merged from one partial sketch a partition, overestimates the count of
every window while holding about one item in fourteen words. A second pass groups only the windows
estimated repeated, exactly, under 128-bit fingerprints of their word sequences (partly summed before the
shuffle). What the groups refute (windows that stand once after all) goes back to its document, and the
third pass removes the words of all other candidate windows. Windows are judged on the input; no window
that stands twice is lost.

Defined results: a null or blank text has 0 words and the hash of the empty string; texts shorter than the
window lose nothing; repeated rows, also with one id, are copies of each other; windows may overlap their
own copies; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import sketch as cms
from voxelspark.llm.arrays import Words, grams, grams128, pieces, whole_runs
from voxelspark.llm.workers import text_batches, tidy

WINDOW, GRAM = 35, 8
DEPTH, CELLS_AN_ITEM = 2, 4.0
#: Words handled at once when anchors are chosen; positions in a block take 24 bits.
BLOCK = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of whole windows, anchor of each as an index of ``keys``, keys of the distinct anchors)."""
    starts = np.flatnonzero(whole_runs(row, window))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    found = grams(hashes, gram)
    at = np.empty(len(starts), np.int64)
    for first in range(0, len(hashes) - window + 1, BLOCK):
        mine = slice(*np.searchsorted(starts, [first, first + BLOCK]))
        part = found[first : first + BLOCK + window - gram]
        packed = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        least = _least_of(packed, window - gram + 1)
        at[mine] = (least[starts[mine] - first] & _LOW).astype(np.int64) + first
    distinct, which = np.unique(at, return_inverse=True)
    return starts, which, found[distinct]


class _Piece:
    """Words, candidate windows and rows of a stretch of a batch."""

    def __init__(self, texts: pa.Array, first: int, last: int, window: int, gram: int):
        self.words = Words.of(texts, first, last)
        self.hashes = self.words.hashes()
        self.starts, self.which, self.keys = anchors(self.hashes, self.words.row, window, gram)

    def candidates(self, sketch: cms.Sketch) -> np.ndarray:
        return self.starts[sketch.repeated(self.keys)[self.which]]


def _grouped(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one member of each distinct pair, members of each)."""
    order = np.lexsort((lo, hi))
    new = np.flatnonzero(np.diff(hi[order], prepend=~hi[order[:1]]).astype(bool) | np.diff(lo[order], prepend=~lo[order[:1]]).astype(bool))
    return order[new], np.diff(np.append(new, len(order)))


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` for every row, and ``kept_text`` if asked for."""
    gram = min(gram, window)
    text_batches(docs.sparkSession)
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    anchors_expected = n_bytes / 6 * 2 / max(2, window - gram + 2)

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        texts = batch.column(0)
        for first, last in pieces(texts):
            yield _Piece(texts, first, last, window, gram).keys

    sketch = cms.build(rows.select("text"), keys, cms.log2_cells(int(anchors_expected), CELLS_AN_ITEM), DEPTH)
    shared = spark.sparkContext.broadcast((sketch.log2, sketch.depth, sketch.twice))

    def received() -> cms.Sketch:
        out = cms.Sketch.__new__(cms.Sketch)
        out.log2, out.depth, out.twice = shared.value
        return out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = received()
        for batch in batches:
            texts, found = batch.column(2), []
            for first, last in pieces(texts):
                piece = _Piece(texts, first, last, window, gram)
                at = piece.candidates(sketch)
                if len(at):
                    hi, lo = grams128(piece.hashes, window)
                    row = piece.words.row[at]
                    found.append((hi[at], lo[at], row + first, at - piece.words.bounds[row]))
            if found:
                hi, lo, row, at = (np.concatenate(x) for x in zip(*found, strict=True))
                one, n = _grouped(hi, lo)
                row = pa.array(row[one])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi[one].view(np.int64)), pa.array(lo[one].view(np.int64)), pa.array(n), batch.column(0).take(row), batch.column(1).take(row), pa.array(at[one].astype(np.int32))],
                    names=["hi", "lo", "n", "id", "digest", "at"],
                )

    grouped = rows.mapInArrow(tidy(windows), f"hi long, lo long, n long, id {kind}, digest long, at int").groupBy("hi", "lo")
    single = grouped.agg(F.sum("n").alias("n"), F.max("id").alias("id"), F.max("digest").alias("digest"), F.max("at").alias("at")).where("n = 1")
    refuted = single.groupBy("id", "digest").agg(F.collect_list("at").alias("refuted"))
    same = F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.digest") == F.col("r.digest"))
    both = rows.alias("d").join(refuted.alias("r"), same, "left").select("d.id", "d.text", "r.refuted")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = received()
        for batch in batches:
            texts, refuted = batch.column(1), batch.column(2)
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for first, last in pieces(texts):
                piece = _Piece(texts, first, last, window, gram)
                words = piece.words
                hit = np.zeros(len(words.start) + 1, bool)
                hit[piece.candidates(sketch)] = True
                part = refuted.slice(first, last - first)
                for i in np.flatnonzero(np.asarray(part.is_valid())):
                    hit[words.bounds[i] + np.asarray(part[int(i)].values)] = False
                change = np.zeros(len(words.start) + window + 1, np.int64)
                at = np.flatnonzero(hit)
                change[at] += 1
                change[at + window] -= 1
                gone = np.cumsum(change)[: len(words.start)] > 0
                for i in range(last - first):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    mine, parts = gone[a:b], texts[first + i].as_py().encode().split()
                    kept = b" ".join(w for w, g in zip(parts, mine.tolist(), strict=True) if not g) if mine.any() else b" ".join(parts)
                    n_words.append(int(b - a))
                    n_removed.append(int(mine.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append(kept.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_texts, pa.string())] * with_text, names=names)

    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return both.mapInArrow(tidy(remove), f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
