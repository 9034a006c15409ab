"""SentencePiece encoding with n-best segmentation, and decoding.

Method: all ways to cut a text into pieces are the paths of a lattice. A forward Viterbi pass gives every
position the best score of any path that reaches it; these are exact heuristics for an A* search that runs
backward from the end, so paths leave the queue best first and the first ``n`` that reach the start are the
``n`` best. Pieces hold a space mark only in front, and (in vocabularies where that is so) never Latin letters
beside ASCII signs or digits, so every path passes the places where a run of spaces begins and where those meet; the
lattice falls apart there, each distinct part is searched once a task (as long as it is remembered), whatever its
length, and the best whole segmentations are combined from the parts' own: of all the places where a part could take a
lesser segmentation only the cheapest ``n - 1`` steps can matter.

Pieces and scores come from the vocabulary file (its model type is not used: scores are read as the
additive scores of a unigram lattice, whatever trained them). A character that starts no piece costs ``UNKNOWN`` less
than the worst piece and is written as its UTF-8 bytes. Equal scores are ordered by fewer pieces.

Defined results: null and empty texts have no pieces, score 0 and no second best; a text whose white space or
length is extreme is encoded whole; decoding gives the text back exactly, save that the space mark itself
(U+2581) becomes a space; repeated rows are encoded each for themselves; extra columns are ignored by
``encode``; empty tables give empty results.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import re
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from voxelspark.llm.workers import text_batches, tidy

SPACE, UNKNOWN = "▁", 10.0
#: Parts of a generation remembered by a task, and characters of them.
MEMORY, CHARACTERS = 200_000, 4_000_000
#: Texts coded at once.
TEXTS = 100
#: Bounds this close count as equal: sums of the same scores in another order.
SLACK = 1e-9
#: Scores at or below this mark pieces that are never chosen; they don't count as the worst.
NEVER = -1e8
_LATIN, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"\x00-@\[-`{-\x7f"
_SPACES, _WORDS = re.compile("▁*[^▁]*"), re.compile(f"▁*(?:[{_LATIN}]+|[{_SIGNS}]+)|▁+")
#: What the second way of cutting isn't meant for, and pieces that reach across its cuts.
_OTHER, _ACROSS = re.compile(f"[^{_LATIN}{_SIGNS}▁]"), re.compile(f"[{_LATIN}][{_SIGNS}]|[{_SIGNS}][{_LATIN}]")


class Pieces:
    """Piece table of one vocabulary."""

    def __init__(self, path: str):
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.names = [p.id_to_piece(i) for i in range(n)]
        #: finds every piece that ends at a position: (length, score, ids)
        self.found = ahocorasick.Automaton()
        for i in plain:
            self.found.add_word(self.names[i], (len(self.names[i]), p.get_score(i), (i,)))
        self.found.make_automaton()
        self.single = {self.names[i] for i in plain if len(self.names[i]) == 1}
        self.byte = {int(self.names[i][1:-1], 16): i for i in range(n) if p.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = min(p.get_score(i) for i in plain if p.get_score(i) > NEVER) - UNKNOWN
        #: of each part met: its best score, what the second best costs, and the best's ids in decimal
        self.known: dict[str, tuple[float, float, str]] = {}
        self.older, self.held = {}, 0
        #: parts whose ids don't spell them, of those remembered
        self.misspelt: set[str] = set()
        self.decimal = [str(i) for i in range(n)]
        self.raw = [bytes([self.value[i]]) if i in self.value else self.names[i].encode() for i in range(n)]
        # no piece may reach across a place where the text is cut
        bare = [self.names[i].lstrip(SPACE) for i in plain]
        assert all(SPACE not in x for x in bare)
        self.apart = not any(_ACROSS.search(x) for x in bare)

    def arcs(self, part: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """Forward Viterbi: the best score at each position, and the pieces that end there as (start, score, ids)."""
        best, out = [0.0] + [-math.inf] * len(part), [[] for _ in range(len(part) + 1)]
        found = self.found.iter(part)
        if not self.single.issuperset(part):
            lone = [(k, (1, self.unknown, tuple(self.byte[x] for x in c.encode()))) for k, c in enumerate(part) if c not in self.single]
            found = sorted([*found, *lone], key=itemgetter(0))
        for b, (length, score, ids) in found:
            b += 1
            a = b - length
            out[b].append((a, score, ids))
            score += best[a]
            if score > best[b]:
                best[b] = score
        return best, out

    def search(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a part, best first: A* backward from the end with exact heuristics.

        Paths leave the queue in the order of what is best in all, so no position needs to be passed more than ``n`` times.
        Bounds are exact, so each path in the queue stands for a whole one that costs just its bound: what is beyond the
        ``n`` least of them never enters. Paths hold a link to the path they go on from; time and memory are linear in the length.
        """
        best, arcs = self.arcs(part)
        push, pushpop, pop = heapq.heappush, heapq.heappushpop, heapq.heappop
        # a path: (bound on the whole path, pieces after the position, a running number, position, score after it, link: a piece and what follows)
        heap: list[tuple] = []
        path = (-best[-1], 0, 0, len(part), 0.0, None)
        passed, out, serial = [0] * (len(part) + 1), [], 0
        # the least bounds of paths beside the first one
        beside, limit = [], math.inf
        while True:
            bound, count, _, at, after, link = path
            # what the queue is given first comes out of it at once if nothing in it is better, mostly so
            ahead = None
            if at == 0:
                ids: list[int] = []
                while link:
                    ids += link[0]
                    link = link[1]
                out.append((after, tuple(ids)))
                if len(out) == n:
                    break
            elif passed[at] < n:
                passed[at] += 1
                first = True
                for a, s, i in arcs[at]:
                    total = -(best[a] + s + after)
                    if first and total <= bound + SLACK:
                        first = False
                    elif total > limit + SLACK:
                        continue
                    else:
                        insort(beside, total)
                        if len(beside) >= n:
                            beside.pop()
                        if len(beside) == n - 1:
                            limit = beside[-1] if beside else bound
                    if passed[a] < n:
                        serial += 1
                        if ahead is not None:
                            push(heap, ahead)
                        ahead = (total, count + len(i), serial, a, s + after, (i, link))
            if ahead is not None:
                path = pushpop(heap, ahead)
            elif heap:
                path = pop(heap)
            else:
                break
        return out

    def learn(self, cuts: list[list[str]]) -> None:
        """Search the parts of a batch of texts that aren't known yet; of two generations of known ones the older is forgotten."""
        if len(self.known) >= MEMORY or self.held >= CHARACTERS:
            self.older, self.known, self.held = self.known, {}, 0
            self.misspelt &= self.older.keys()
        known, older, raw, decimal = self.known, self.older, self.raw, self.decimal
        for part in {p for parts in cuts for p in parts if p not in known}:
            self.held += len(part)
            if part in older:
                known[part] = older[part]
                continue
            found = self.search(part, 2)
            score, ids = found[0]
            less = score - found[1][0] if len(found) > 1 else math.inf
            known[part] = (score, less, " ".join([decimal[i] for i in ids]))
            if b"".join([raw[i] for i in ids]) != part.encode():
                self.misspelt.add(part)

    def marked(self, text: str) -> str:
        """The text as the lattice sees it: a space in front, spaces as marks."""
        return (" " + text).replace(" ", SPACE) if text else ""

    def cut(self, text: str) -> list[str]:
        marked = self.marked(text)
        found = (_WORDS if self.apart and not _OTHER.search(marked) else _SPACES).findall(marked)
        return found if not found or found[-1] else found[:-1]

    def nbest(self, text: str | None, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a text, best first (fewer if there are fewer)."""
        return self.nbest_all([text], n)[0]

    def nbest_all(self, texts: list[str | None], n: int) -> list[list[tuple[float, list[int]]]]:
        cuts = [self.cut(text or "") for text in texts]
        self.learn(cuts)
        return [self.combined(parts, n) for parts in cuts]

    def combined(self, parts: list[str], n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best of the whole, from those of its parts."""
        known = [self.known[p] for p in parts]
        best = [[int(i) for i in p[2].split()] for p in known]
        base = sum([p[0] for p in known])
        # the parts whose second best costs least: others can't be in the n best
        some = sorted(k for x, k in heapq.nsmallest(n - 1, zip([p[1] for p in known], range(len(known)), strict=True)) if x < math.inf)
        lesser = {k: self.search(parts[k], n) for k in some}
        seen, heap = {(0,) * len(some)}, [(0.0, (0,) * len(some))]
        out = []
        while heap and len(out) < n:
            lost, choice = heapq.heappop(heap)
            pick = dict(zip(some, choice, strict=True))
            out.append((base - lost, [i for k, ids in enumerate(best) for i in (lesser[k][pick[k]][1] if k in pick else ids)]))
            for d, k in enumerate(some):
                after = (*choice[:d], choice[d] + 1, *choice[d + 1 :])
                if after[d] < len(lesser[k]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (sum(lesser[m][0][0] - lesser[m][c][0] for m, c in zip(some, after, strict=True)), after))
        return out

    def two_best(self, texts: list[str | None]) -> Iterator[tuple[float, float | None, bytes, str, bool]]:
        """Of each text the best score, the second best's, and the best's ids (32-bit numbers, decimal) and whether decoding them gives the text back.

        Decoding puts pieces' bytes end to end, so a text comes back if each part does.
        """
        cuts = [self.cut(text or "") for text in texts]
        self.learn(cuts)
        known = self.known.__getitem__
        for parts in cuts:
            if parts:
                scores, losses, decimal = zip(*map(known, parts))
                score, less = sum(scores), min(losses)
                joined = " ".join(decimal)
                ids = np.fromstring(joined, np.int32, sep=" ").tobytes()
                yield score, None if less == math.inf else score - less, ids, joined, not self.misspelt or self.misspelt.isdisjoint(parts)
            else:
                yield 0.0, None, b"", "", True

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col, n_pieces, score, second_score, ids_sha256, decoded`` of every row, and ``ids`` if asked for.

    ``second_score`` is that of the next best segmentation (null if there is none), ``ids_sha256`` the hash of the
    best one's ids in decimal joined by spaces, ``decoded`` whether decoding them gives the text back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary)
        gc.disable()  # all that is made here is free of cycles; walking the known parts again and again costs much
        try:
            for batch in batches:
                for first in range(0, len(batch), TEXTS):
                    yield coded(p, batch.slice(first, TEXTS))
        finally:  # a worker goes on to other operators
            p.known, p.older, p.held, p.misspelt = {}, {}, 0, set()
            gc.enable()

    def coded(p: Pieces, part: pa.RecordBatch) -> pa.RecordBatch:
        count, score, second, digest, same, all_ids = [], [], [], [], [], []
        for best, next_best, ids, decimal, spelt in p.two_best(part.column(1).to_pylist()):
            count.append(len(ids) // 4)
            score.append(best)
            second.append(next_best)
            digest.append(hashlib.sha256(decimal.encode()).hexdigest())
            same.append(spelt)
            if with_ids:
                all_ids.append(ids)
        columns = [part.column(0), pa.array(count, pa.int64()), pa.array(score, pa.float64()), pa.array(second, pa.float64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
        if with_ids:
            ends = np.cumsum([0, *count], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(all_ids), np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    text_batches(docs.sparkSession)
    names = [id_col, "n_pieces", "score", "second_score", "ids_sha256", "decoded"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_pieces long, score double, second_score double, ids_sha256 string, decoded boolean" + ", ids array<int>" * with_ids)


def encode_nbest(docs: DataFrame, vocabulary: str, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, rank, score, ids`` of the ``n`` best segmentations of every row (as many as there are), best first from rank 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary)
        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                part = batch.slice(first, TEXTS)
                found = [(k, rank, *x) for k, row in enumerate(p.nbest_all(part.column(1).to_pylist(), n)) for rank, x in enumerate(row, 1)]
                row, rank, score, ids = zip(*found, strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "rank", "score", "ids"]
                )

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` of every row of piece ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")
