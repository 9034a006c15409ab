"""Token counts of whole texts under a byte-level BPE vocabulary with word ends.

Method: rank-synchronous array merging. Distinct pre-tokens of a batch lie end to end in one ragged
numpy array; every round finds each sequence's lowest-rank pair and merges all its occurrences in all
sequences at once, until no sequence has a pair left. The symbols that survive are the tokens. A merge
only makes pairs of higher rank than itself, so a round equals the one-at-a-time order. Sequences of more
than ``LONG`` bytes have many rounds, so those are merged rank by rank, all of them together, and a round
touches only the pairs of its rank and their neighbours.

Texts are cut to pre-tokens by the library's own normaliser and pre-tokenizer (each distinct word once), so
letters, numbers and lower case are those of its version of Unicode.

Defined results: a null text counts as empty (0 bytes, 0 tokens); white space alone gives 0 tokens; the
strings of added special tokens count as one token each wherever they stand, as the library does by
default; no truncation. Repeated rows are counted each for themselves. Extra columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from voxelspark.llm.workers import text_batches, tidy

#: The end-of-word mark, and control characters that Python's split() takes for white space but \s doesn't.
WORD_END, NOT_SPACE = "</w>", "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\s+")
#: Words remembered by a worker; beyond this the memory starts anew.
MEMORY = 400_000
#: Bytes of a pre-token from which it is merged rank by rank.
LONG = 256
_DONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """Merge table of one vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.width = len(vocab)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + WORD_END] for s in symbols], np.int64)
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte = {s: k for k, s in enumerate(symbols)}
        self.known: dict[str, int] = {}

    def _rank(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], _DONE)

    def _symbols(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all sequences end to end, whose they are)."""
        lengths = np.array([len(r) for r in raw], np.int64)
        symbols = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        symbols[np.cumsum(lengths) - 1] = self.final[np.frombuffer(b"".join(r[-1:] for r in raw), np.uint8)]
        return symbols, np.repeat(np.arange(len(raw)), lengths)

    def merged(self, raw: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token."""
        long = np.array([len(r) > LONG for r in raw])
        out = np.zeros(len(raw), np.int64)
        for which, merge in ((~long, self._merged), (long, self._merged_by_rank)):
            if which.any():
                out[which] = merge([raw[k] for k in np.flatnonzero(which)])
        return out

    def _merged_by_rank(self, raw: list[bytes]) -> np.ndarray:
        """The same for long sequences: places wait under the rank of their pair; the lowest rank is merged wherever it still stands."""
        symbols, owner = self._symbols(raw)
        out, places = np.bincount(owner, minlength=len(raw)), np.arange(len(symbols))
        after, before = places + 1, places - 1
        after[np.flatnonzero(np.diff(owner, append=-1))] = -1
        before[np.flatnonzero(np.diff(owner, prepend=-1))] = -1
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self._rank(symbols[at] * self.width + symbols[after[at]])
            order = np.argsort(rank, kind="stable")
            order = order[: np.searchsorted(rank[order], _DONE)]
            cuts = np.flatnonzero(np.diff(rank[order], prepend=-1))
            for part in np.split(order, cuts[1:]) if len(order) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(at[part])

        wait(places)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            # places that were merged away have no symbol, others have another pair by now
            at = at[(symbols[at] >= 0) & (after[at] >= 0)]
            at = at[self._rank(symbols[at] * self.width + symbols[after[at]]) == r]
            if not len(at):
                continue
            # in a run of adjacent hits (one symbol repeated) every other one merges, from the left
            joined = np.append(False, after[at[:-1]] == at[1:])
            start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            symbols[at], symbols[gone] = self.made[r], -1
            after[at] = after[gone]
            follows = after[at] >= 0
            before[after[at[follows]]] = at[follows]
            np.subtract.at(out, owner[at], 1)
            left = before[at]
            wait(np.unique(np.concatenate([at, left[left >= 0]])))
        return out

    def _merged(self, raw: list[bytes]) -> np.ndarray:
        """Round by round over all sequences."""
        symbols, owner = self._symbols(raw)
        out = np.bincount(owner, minlength=len(raw))
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            rank = np.where(same, self._rank(symbols[:-1] * self.width + symbols[1:]), _DONE)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(np.append(rank, _DONE), starts)
            least = np.repeat(lowest, np.diff(np.append(starts, len(owner))))
            hit = (rank == least[:-1]) & (rank != _DONE)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # in a run of adjacent hits (one symbol repeated) every other one merges, from the left
            new_run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            run = np.repeat(new_run, np.diff(np.append(new_run, len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            np.subtract.at(out, owner[at], 1)
            keep = lowest[np.searchsorted(starts, np.arange(len(owner)), "right") - 1] != _DONE
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def learn(self, words: list[str]) -> None:
        parts, flat = [], {}
        for word in words:
            parts.append([flat.setdefault(p, len(flat)) for p, _ in self.split(self.normalize(word))])
        counts = self.merged([bytes(map(self.byte.__getitem__, p)) for p in flat]) if flat else np.zeros(0, np.int64)
        self.known.update((word, int(sum(counts[i] for i in p))) for word, p in zip(words, parts, strict=True))

    def words(self, text: str) -> list[str]:
        return [w for w in _SPACE.split(text) if w] if any(c in text for c in NOT_SPACE) else text.split()

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; words not met before are merged together."""
        if len(self.known) > MEMORY:
            self.known.clear()
        extra, split = [], []
        for text in texts:
            n, text = 0, text or ""
            if "<|" in text:
                for s in self.specials:
                    n += text.count(s)
                    text = text.replace(s, " ")
            extra.append(n)
            split.append(self.words(text))
        new = [w for w in dict.fromkeys(w for words in split for w in words) if w not in self.known]
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        known = self.known.__getitem__
        return [n + sum(map(known, words)) for n, words in zip(extra, split, strict=True)]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row; ``vocabulary`` is a path present on every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in batches:
            texts, bytes_, tokens = batch.column(1), [], []
            for i in range(0, len(texts), 500):
                part = texts.slice(i, 500).to_pylist()
                bytes_ += [len((t or "").encode()) for t in part]
                tokens += m.counts(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bytes_, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
