"""Main text of web pages: a recurrent block labeller.

Method: the page is cut into leaf blocks; a bidirectional LSTM in numpy reads, for each leaf in document
order, the vectors of its tag path (tags, class and id words of its ancestors) and of its hashed words with
a few counts, and labels every block with the whole document as context. The blocks labelled main are
joined. The network is small and is trained here, on ``TRAIN_PAGES`` made-up pages with known main text
(``html_pages``), once a process; no page of the input is looked at for learning.

Defined results: null and empty pages, and pages without main text, give an empty text; character
references are decoded; white space in a block becomes one space; unclosed and unmatched tags are
tolerated; an element without text (a form's, a picture's) that is never closed ends with the next tag of a block,
a script or style that is never closed with the page; a quote opens a value only after an equals sign; repeated rows are extracted each for themselves; extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.html_pages import made
from voxelspark.llm.workers import text_batches, tidy

TRAIN_PAGES, EPOCHS, SEED = 2000, 8, 7
#: Buckets of hashed path items and words, widths of their vectors, hidden units in each direction, other inputs.
PATH_BUCKETS, WORD_BUCKETS, PATH_WIDTH, WORD_WIDTH, HIDDEN, COUNTS = 1024, 1024, 16, 8, 20, 8
#: Blocks of all pages that go through the network at once.
BLOCKS = 8192

#: Tags that don't break a block, tags without content, tags that close themselves.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_SELF = frozenset("p li dt dd tr td th option".split())
#: Tags that stand within an element without text.
WITHIN = frozenset("option optgroup source param track path g circle rect line polyline polygon ellipse text tspan defs use symbol title desc".split())
#: Tags whose content is no text.
TEXTLESS = frozenset("script style template noscript svg iframe textarea select".split())
#: What stands in a tag behind its name: a value in quotes may hold a closing bracket.
_INNER = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)({_INNER})(?:>|\Z)", re.S)
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in TEXTLESS}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+|\d+")
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=4096)
def _items(tag: str, attributes: str) -> tuple[int, ...]:
    """Buckets of an element: its tag and the words of its class, id and role."""
    names = [tag, *(f".{w.lower()}" for m in _ATTRIBUTE.finditer(attributes) for w in _PART.findall(m[2] or m[3] or m[4] or ""))]
    return tuple(zlib.crc32(n.encode()) % PATH_BUCKETS for n in names)


class Block:
    __slots__ = ("text", "path", "depth", "linked")

    def __init__(self, text: str, path: tuple[int, ...], depth: int, linked: int):
        self.text, self.path, self.depth, self.linked = text, path, depth, linked


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in document order."""
    page, out = page or "", []
    # open elements: tag, its items and the distinct items of the path down to it
    stack: list[tuple[str, tuple[int, ...]]] = []
    text: list[str] = []
    linked, in_link, at, hidden = 0, 0, 0, False

    def flush() -> None:
        nonlocal linked
        joined = "".join(text)
        if "&" in joined:
            joined = entities.unescape(joined)
        joined = _SPACE.sub(" ", joined).strip()
        if joined:
            out.append(Block(joined, stack[-1][1] if stack else (), len(stack), min(linked, len(joined))))
        text.clear()
        linked = 0

    while m := _TAG.search(page, at):
        if m.start() > at and not hidden:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in TEXTLESS:
            if not closing and not m[3].rstrip().endswith("/"):
                end = _CLOSE[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    hidden = True
            continue
        if tag in ("a", "button"):
            in_link = 0 if closing else 1
        if tag in INLINE or (hidden and tag in WITHIN):
            continue
        hidden = False
        flush()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if stack and stack[-1][0] == tag and tag in CLOSES_SELF:
                stack.pop()
            stack.append((tag, tuple(dict.fromkeys((stack[-1][1] if stack else ()) + _items(tag, m[3].strip())))))
    if not hidden:
        text.append(page[at:])
    flush()
    return out


def features(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat path items and words with where each block's begin, and the counts of each block."""
    paths, words, path_at, word_at, counts = [], [], [0], [0], []
    for blocks in pages:
        total = sum(len(b.text) for b in blocks) or 1
        seen = 0
        for k, b in enumerate(blocks):
            paths.extend(b.path or (0,))
            path_at.append(len(paths))
            found = b.text.lower().split(" ")
            words.extend([zlib.crc32(w.encode()) % WORD_BUCKETS for w in found])
            word_at.append(len(words))
            n = len(b.text)
            counts.append(
                (np.log1p(n) / 6, np.log1p(len(found)) / 5, b.linked / n, sum(map(b.text.count, ".,!?")) / len(found), k / len(blocks), seen / total, b.depth / 10, n / total)
            )
            seen += n
    return np.array(paths, int), np.array(path_at, int), np.array(words, int), np.array(word_at, int), np.array(counts, np.float64).reshape(-1, COUNTS)


def _means(table: np.ndarray, items: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[items], at[:-1], axis=0) / np.diff(at)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Embeddings, two LSTMs (gates in order input, forget, output, new) and a logistic layer."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        width = PATH_WIDTH + WORD_WIDTH + COUNTS
        scale = lambda *s: r.normal(size=s) / np.sqrt(s[0])
        self.p = {"path": r.normal(size=(PATH_BUCKETS, PATH_WIDTH)), "word": r.normal(size=(WORD_BUCKETS, WORD_WIDTH)), "out": scale(2 * HIDDEN, 1), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"{d}x"], self.p[f"{d}h"] = scale(width, 4 * HIDDEN), scale(HIDDEN, 4 * HIDDEN)
            self.p[f"{d}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states over (time, page, input); a masked step hands the state on."""
        p, steps, n = self.p, *mask.shape
        h, c, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((steps, n, HIDDEN))
        z_in = x @ p[f"{d}x"] + p[f"{d}c"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ p[f"{d}h"]
            gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            m = mask[t][:, None]
            c_new = f * c + i * new
            tanh_c = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, new, tanh_c, m))
            h, c = m * (o * tanh_c) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out

    def _inputs(self, pages: list[list[Block]]) -> tuple:
        path, path_at, word, word_at, counts = features(pages)
        flat = np.concatenate([_means(self.p["path"], path, path_at), _means(self.p["word"], word, word_at), counts], axis=1)
        lengths = np.array([len(b) for b in pages])
        page = np.repeat(np.arange(len(pages)), lengths)
        step = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        x, mask = np.zeros((lengths.max(), len(pages), flat.shape[1])), np.zeros((lengths.max(), len(pages)))
        x[step, page], mask[step, page] = flat, 1.0
        return x, mask, step, page, (path, path_at, word, word_at)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        first = 0
        while first < len(order):
            last = first + 1
            while last < len(order) and (last + 1 - first) * len(pages[order[last]]) <= BLOCKS:
                last += 1
            some = order[first:last]
            x, mask, step, page, _ = self._inputs([pages[k] for k in some])
            both = np.concatenate([self._run("f", x, mask, None), self._run("b", x, mask, None)], axis=2)
            score = (both @ self.p["out"])[:, :, 0] + self.p["bias"]
            for n, k in enumerate(some):
                out[k] = score[: len(pages[k]), n] > 0
            first = last
        return out

    def step(self, pages: list[list[Block]], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Loss of a batch and its gradient, by back-propagation through time."""
        p = self.p
        x, mask, step, page, (path, path_at, word, word_at) = self._inputs(pages)
        kept = {d: [] for d in "fb"}
        both = np.concatenate([self._run(d, x, mask, kept[d]) for d in "fb"], axis=2)
        y = np.zeros(mask.shape)
        y[step, page] = np.concatenate(labels)
        score = (both @ p["out"])[:, :, 0] + p["bias"]
        chance, n = _sigmoid(score), mask.sum()
        loss = -(mask * (y * np.log(chance + 1e-12) + (1 - y) * np.log(1 - chance + 1e-12))).sum() / n
        d_score = mask * (chance - y) / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"] = np.einsum("tnh,tn->h", both, d_score)[:, None], np.array([d_score.sum()])
        d_both, d_x = d_score[:, :, None] * p["out"][:, 0], np.zeros_like(x)
        for k, d in enumerate("fb"):
            d_out = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
            for t, h, c, i, f, o, new, tanh_c, m in reversed(kept[d]):
                dh = dh + d_out[t]
                dh_new, dh = m * dh, (1 - m) * dh
                dc_new = m * dc + dh_new * o * (1 - tanh_c**2)
                dz = np.concatenate([dc_new * new * i * (1 - i), dc_new * c * f * (1 - f), dh_new * tanh_c * o * (1 - o), dc_new * i * (1 - new**2)], axis=1)
                g[f"{d}h"] += h.T @ dz
                g[f"{d}c"] += dz.sum(axis=0)
                g[f"{d}x"] += x[t].T @ dz
                d_x[t] += dz @ p[f"{d}x"].T
                dh, dc = dh + dz @ p[f"{d}h"].T, dc_new * f + (1 - m) * dc
        flat = d_x[step, page]
        np.add.at(g["path"], path, np.repeat(flat[:, :PATH_WIDTH] / np.diff(path_at)[:, None], np.diff(path_at), axis=0))
        np.add.at(g["word"], word, np.repeat(flat[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / np.diff(word_at)[:, None], np.diff(word_at), axis=0))
        return float(loss), g


_MARK = re.compile("\x02(\\d+)\x03")


def example(seed: int) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made-up page and their labels (a block is main if its first leaf is)."""
    page, truth = made(seed)
    blocks, labels = [], []
    for b in blocks_of(page):
        marks = _MARK.findall(b.text)
        b.text = _MARK.sub("", b.text).strip()
        if marks and b.text:
            blocks.append(b)
            labels.append(float(truth[int(marks[0])]))
    return blocks, np.array(labels)


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller after Adam on made-up pages; the same wherever it is made."""
    data = [e for e in map(example, range(pages)) if len(e[0])]
    net, r, t = Labeller(seed), np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for epoch in range(epochs):
        rate = 0.02 * (0.6**epoch)
        order = sorted(range(len(data)), key=lambda k: (len(data[k][0]) // 8, r.random()))
        batches = [order[k : k + 32] for k in range(0, len(order), 32)]
        for k in r.permutation(len(batches)):
            _, g = net.step([data[i][0] for i in batches[k]], [data[i][1] for i in batches[k]])
            t += 1
            for name, d in g.items():
                first[name] += 0.1 * (d - first[name])
                second[name] += 0.01 * (d * d - second[name])
                net.p[name] -= rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-8)
    return net


def extract(net: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks_of(p) for p in pages]
    return [" ".join(b.text for b, main in zip(blocks, labels, strict=True) if main) for blocks, labels in zip(found, net.label(found), strict=True)]


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page."""
    text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(trained().p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller.__new__(Labeller)
        net.p = shared.value
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = extract(net, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, `{url_col}` string, text string")
    return found.select(id_col, url_col, "text", F.char_length("text").cast("long").alias("n_chars"))
