"""Toxicity score of whole texts from a weighted lexicon.

Method: the text is folded (case, accents, homoglyphs of other scripts, digits and signs that stand for
letters in words), a weighted lexicon of words and word stems is matched by Aho-Corasick, hits that lie in
an exception phrase are cancelled, and the summed weight normalised by length gives the score. A sign or
digit at the end of a word may be a letter or not, so such texts are matched in both readings and each word
counts in the heavier one. Weights are smoothed log odds learnt from a bounded sample of labelled rows
(``SAMPLE_ROWS``), and so are exceptions: pairs of words with a lexicon word that clean rows repeat and toxic
rows don't have. The score is a logistic curve over the summed weight and the weight a word, fitted on the
same rows.

Defined results: null and empty texts score as texts without a hit; a null id is never held out; repeated
rows are scored each for themselves; a row without a label takes no part in learning; with no usable
label the fixed lexicon and curve hold; labels that contradict each other count as toxic. Columns other
than id and text are never read. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.workers import release, text_batches, tidy

#: Labelled rows that are looked at for learning, at most: those whose id has the smallest hash.
SAMPLE_ROWS = 30_000
#: Least evidence (in nats) that a pattern is toxic, and clean rows a pair of words needs to be an exception.
EVIDENCE, HARMLESS = 12.0, 5
#: Lengths of word stems; least weight (log odds) of a pattern.
STEMS, LEAST_WEIGHT = range(5, 9), 3.5

#: Look-alike letters of other scripts and the letters they stand for.
HOMOGLYPHS = dict(
    zip("авеёкмнорстухіјѕԁԛԝɡһӏαβεικνορτυχγωⅰℓ", "abeekmhopctyxijsdqwghlabeiknoptuxywil", strict=True)
)
#: Digits and signs inside words and the letters they stand for.
SUBSTITUTES = dict(zip("013457@$!|", "oieastasii", strict=True))
#: Insults that count before anything is learnt, with their weight.
BASE_WORDS, BASE_WEIGHT = "idiot moron stupid imbecile scumbag bastard asshole bitch fuck shit cunt faggot retard dumbass douchebag".split(), 4.0
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum", "stupid question", "shit happens")
#: Intercept and slopes (summed weight, weight a word) before anything is learnt.
BASE_CURVE = (-3.0, 2.0, 0.5)


def _letters() -> dict[int, str]:
    """Lower-case accented Latin and full-width letters to their base, and look-alikes to Latin."""
    table = {ord(a): b for a, b in HOMOGLYPHS.items()}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if "a" <= base <= "z":
            table.setdefault(code, base)
    return table


_LETTERS = _letters()
_MARKS = re.compile("[̀-ͯ​-‏­﻿]")
_SUBSTITUTE = re.compile(r"(?:[%s])+(?=[^\W\d_])" % re.escape("".join(SUBSTITUTES)))
#: The same at the end of a word.
_FINAL = re.compile(r"(?<=[^\W\d_])[%s]+" % re.escape("".join(SUBSTITUTES)))
_BREAKS = re.compile(r"[\W\d_]+")
_SUB_TABLE = str.maketrans(SUBSTITUTES)


def readings(text: str | None) -> tuple[str, str]:
    """The folded text twice: without and with the letters that signs at the ends of words may stand for.

    Words stand between single spaces, with one in front and behind, as many in one as in the other; l and i are one letter.
    """
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", text).translate(_LETTERS)
    text = _SUBSTITUTE.sub(lambda m: m[0].translate(_SUB_TABLE), text)
    spaced = lambda t: f" {x} ".replace("l", "i") if (x := _BREAKS.sub(" ", t).strip()) else " "
    plain = spaced(text)
    return plain, spaced(_FINAL.sub(lambda m: m[0].translate(_SUB_TABLE), text)) if _FINAL.search(text) else plain


def fold(text: str | None) -> str:
    return readings(text)[0]


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in either reading."""
    plain, other = readings(text)
    return set(plain.split()) if other is plain else {*plain.split(), *other.split()}


def patterns_of(word: str) -> list[str]:
    """The whole word, and its stems: a pattern that ends in a space is a whole word."""
    return [f" {word} ", *(f" {word[:k]}" for k in STEMS if k < len(word))] if len(word) >= 3 else []


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=lambda: {f" {fold(w).strip()} ": BASE_WEIGHT for w in BASE_WORDS})
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = BASE_CURVE

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            phrase = fold(phrase)
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def _hits(self, automaton: ahocorasick.Automaton, folded: str) -> tuple[dict[int, float], set[int]]:
        """(weight of the heaviest pattern at each place, places that an exception spares)."""
        hits: dict[int, float] = {}
        phrases: list[tuple[int, int]] = []
        if len(automaton):
            for end, (length, weight) in automaton.iter(folded):
                start = end - length + 1
                if weight is None:
                    phrases.append((start, end))
                elif weight > hits.get(start, 0.0):
                    hits[start] = weight
        return hits, {h for first, last in phrases for h in hits if first <= h < last}

    def match(self, automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, int, int]:
        """Summed weight, words hit (the heaviest pattern of each counts) and words."""
        plain, other = readings(text)
        hits, spared = self._hits(automaton, plain)
        words = max(0, plain.count(" ") - 1)
        if other is not plain:
            more, also = self._hits(automaton, other)
            if more.keys() - hits.keys() or also or more != hits:
                # by number of the word, which is the same in both
                nth = lambda folded, places: {h: folded.count(" ", 0, h) for h in places}
                one, two = nth(plain, hits), nth(other, more)
                spared = {one[h] for h in spared} | {two[h] for h in also}
                hits = {one[h]: w for h, w in hits.items()}
                for h, w in more.items():
                    hits[two[h]] = max(w, hits.get(two[h], 0.0))
        kept = [hits[k] for k in sorted(hits) if k not in spared]
        return sum(kept), len(kept), words

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        x = a + b * np.log1p(weight) + c * np.log1p(1000 * weight / np.maximum(words, 1))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, toxic) of the bounded sample; the side that is broadcast has ``rows`` rows at most."""
    flags = (
        labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("_id"))
        .groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # copies of one text are one observation
    return texts.join(F.broadcast(flags), "_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Lexicon:
    """Weights, exceptions and curve from labelled rows that are not held out."""
    text_batches(docs.sparkSession)
    sample = _labelled(docs, labels, id_col, text_col, rows).cache()
    try:
        totals = {int(t): n for t, n in sample.groupBy("toxic").count().collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)
        if toxic < 5 or clean < 5:
            return Lexicon()

        def support(wanted: set[str] | None):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counts: Counter[str] = Counter()
                for batch in batches:
                    for text in batch.column(0):
                        found = {p for w in words_of(text.as_py()) for p in patterns_of(w)}
                        counts.update(found if wanted is None else found & wanted)
                        if len(counts) > 200_000:
                            yield pa.RecordBatch.from_pydict({"pattern": list(counts), "n": list(counts.values())})
                            counts.clear()
                yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

            return run

        def counted(flag: int, wanted: set[str] | None) -> DataFrame:
            return sample.where(F.col("toxic") == flag).select("text").mapInArrow(tidy(support(wanted)), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))

        # fewer rows than that can't give the evidence a pattern needs; patterns of a bounded sample are bounded
        least = max(3, math.ceil(EVIDENCE / math.log((toxic + clean) / toxic)))
        pos = dict(counted(1, None).where(F.col("n") >= least).collect())
        neg = dict(counted(0, set(pos)).collect())
        lexicon = Lexicon(weights=_weights(pos, neg, toxic, clean) | {k: v for k, v in Lexicon().weights.items() if neg.get(k, 0) == 0})

        def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pairs of neighbouring words one of which is in the lexicon."""
            automaton, counts = lexicon.automaton(), Counter()
            for batch in batches:
                for toxic, text in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                    folded = fold(text.as_py())
                    hits, _ = lexicon._hits(automaton, folded)
                    if hits:
                        words = folded.split()
                        at = {folded.count(" ", 0, h) for h in hits}
                        counts.update({(f"{words[k]} {words[k + 1]}", toxic) for i in at for k in (i - 1, i) if 0 <= k < len(words) - 1})
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in counts], pa.string()), "toxic": pa.array([t for _, t in counts], pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

        by = sample.mapInArrow(tidy(contexts), "phrase string, toxic long, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
        harmless = by.where((F.col("bad") == 0) & (F.col("n") >= HARMLESS)).select("phrase").orderBy("phrase").collect()
        lexicon.exceptions += tuple(r[0] for r in harmless)

        def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = lexicon.automaton()
            for batch in batches:
                found = [lexicon.match(automaton, t.as_py()) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64())], names=["toxic", "weight", "words"])

        got = sample.mapInArrow(tidy(matches), "toxic int, weight double, words long").toPandas().sort_values(["toxic", "weight", "words"])
        lexicon.curve = _fit(got.toxic.to_numpy() == 1, got.weight.to_numpy(float), got.words.to_numpy(float))
        return lexicon
    finally:
        sample.unpersist()
        release()


def _weights(pos: dict[str, int], neg: dict[str, int], toxic: int, clean: int) -> dict[str, float]:
    rate, out = toxic / (toxic + clean), {}
    for pattern in sorted(pos, key=lambda p: (len(p), p)):
        p, n = pos[pattern], neg.get(pattern, 0)
        t = p + n
        evidence = p * np.log(p / t / rate) + (n * np.log(n / t / (1 - rate)) if n else 0.0)
        weight = float(np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1)))
        if p / t <= rate or evidence < EVIDENCE or weight < LEAST_WEIGHT:
            continue
        word = pattern.strip()
        if not any(out.get(f" {word[:k]}", 0) >= 0.9 * weight for k in STEMS if k <= len(word)):
            out[pattern] = round(weight, 4)
    return out


def _fit(y: np.ndarray, weight: np.ndarray, words: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression with a little ridge on the slopes, by Newton steps."""
    x = np.column_stack([np.ones(len(y)), np.log1p(weight), np.log1p(1000 * weight / np.maximum(words, 1))])
    b, penalty = np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted, n_hits, n_words`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [lexicon.match(automaton, t.as_py()) for t in batch.column(1)]
            scores = lexicon.score(np.array([x[0] for x in found], float), np.array([x[2] for x in found], float))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
                names=[id_col, "score", "predicted", "n_hits", "n_words"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, score double, predicted int, n_hits long, n_words long")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted", "n_hits", "n_words")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [lexicon.match(automaton, t.as_py()) for t in batch.column(at)]
            scores = lexicon.score(np.array([x[0] for x in found], float), np.array([x[2] for x in found], float))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
