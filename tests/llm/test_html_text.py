import html
import re
import zlib

import numpy as np
import pytest

from voxelspark.llm import html_text as H


def test_gradient():
    """Back-propagation against finite differences."""
    net = H.Labeller(3)
    data = [H.example(s) for s in (1, 2)]
    pages, labels = [d[0][:6] for d in data], [d[1][:6] for d in data]
    _, g = net.step(pages, labels)
    r = np.random.default_rng(0)
    for name, value in net.p.items():
        flat, d = value.reshape(-1), g[name].reshape(-1)
        for at in [int(np.abs(d).argmax()), int(r.integers(len(flat)))]:
            was = flat[at]
            flat[at] = was + 1e-5
            up = net.step(pages, labels)[0]
            flat[at] = was - 1e-5
            down = net.step(pages, labels)[0]
            flat[at] = was
            assert d[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_pages():
    net = H.trained()
    data = [H.example(s) for s in range(90_000, 90_200)]
    got = net.label([d[0] for d in data])
    right = np.concatenate([a == (b > 0) for a, (_, b) in zip(got, data, strict=True)])
    assert right.mean() > 0.99


def article(page):
    inner = page[page.index("<article>") : page.index("</article>")]
    text = re.sub(r"<[^>]+>", lambda m: " " if re.match(r"</?(p|h1|br)", m[0]) else "", inner)
    return " ".join(html.unescape(re.sub(r"\s+", " ", text)).split())


def test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    got = H.main_text(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text == article(pages[r.page_id]) for r in got) >= 0.995 * len(pages)


def test_blocks():
    page = "<title>T</title><div class='x y-z'>a <b>b</b>\n c&amp;d<br>e<script>no</p></script><p>f<p>g</div></b>h<!-- i -->j<style>k"
    assert [b.text for b in H.blocks_of(page)] == ["T", "a b c&d", "e", "f", "g", "hj"]
    assert H.blocks_of(None) == H.blocks_of("") == [] and [b.text for b in H.blocks_of("a < b")] == ["a < b"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a<svg class=i /><p>b<p>c", ["a", "b", "c"]),
        ("<p>a<svg class=i><path d=x><p>b<p>c", ["a", "b", "c"]),
        ("<p>a<select><option>x<option>y</p>b<p>c", ["a", "b", "c"]),
        ("<p>a<textarea>t<div>b</div>", ["a", "b"]),
        ("<div>a<iframe src=u><p>b", ["a", "b"]),
        ("<div>a<noscript><img src=u></div><p>b", ["a", "b"]),
        ("<p>a<select><option>x</select> b<svg><title>t</title></svg> c", ["a b c"]),
        ("<svg-icon>a</svg-icon><select-box>b</select-box>", ["a", "b"]),
        ('<p title="x>b<p>c', ["b", "c"]),
        ("<p title=it's>b</p><p>don't</p>", ["b", "don't"]),
        ('<p title="a > b" class=\'c>d\'>b', ["b"]),
        ("<p title = 'a>b' x>c<p", ["c"]),
        ("<script>a<p>b</script>c<style>d", ["c"]),
        ("a <b and 3 < 4", ["a"]),
        ("1 < 2 <p>b", ["1 < 2", "b"]),
    ],
)
def test_broken_markup(page, want):
    assert [b.text for b in H.blocks_of(page)] == want


def test_deep_paths():
    """A menu fifteen elements deep keeps its nav, and plain wrappers add nothing."""
    page = "<nav class=menu>" + "<div>" * 14 + "a" + "</div>" * 14 + "</nav><article><p>b"
    a, b = H.blocks_of(page)
    nav = H._items("nav", "class=menu")
    assert set(nav) <= set(a.path) and not set(nav) & set(b.path) and len(a.path) == len(set(a.path)) == len(nav) + 1
    long = "The harbour was quiet that morning and nobody spoke of what had happened during the long night before. " * 4
    menu = "<nav class='menu'>" + "<div>" * 14 + "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul>" + "</div>" * 14 + "</nav>"
    page = f"<html><body>{menu}<article><h1>Harbour</h1><p>{long}</p><p>{long}</p></article></body></html>"
    got = H.extract(H.trained(), [page])[0]
    assert "Home" not in got and "News" not in got and long.strip() in got


def test_very_long_page():
    sentence = "A plain sentence of the article, one of very many. "
    page = f"<body><nav><a href=/>Home</a></nav><article><p>{sentence * 40_000}</p><p>{sentence * 3}</p></article></body>"
    assert H.extract(H.trained(), [page, None])[0].count("one of very many.") == 40_003


def test_plain_forward():
    """The batched, masked network against one step at a time, one page at a time."""
    net = H.Labeller(5)
    pages = [H.example(s)[0][: 3 + 4 * s] for s in range(4)]
    pages.append([])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def lstm(d, xs):
        h, c, out = np.zeros(H.HIDDEN), np.zeros(H.HIDDEN), []
        for x in xs:
            z = x @ net.p[f"{d}x"] + h @ net.p[f"{d}h"] + net.p[f"{d}c"]
            i, f, o, new = np.split(z, 4)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(new)
            h = sigmoid(o) * np.tanh(c)
            out.append(h)
        return out

    def plain(blocks):
        total, seen, xs = sum(len(b.text) for b in blocks), 0, []
        for k, b in enumerate(blocks):
            words = b.text.lower().split(" ")
            n = len(b.text)
            path = np.mean([net.p["path"][i] for i in b.path or (0,)], axis=0)
            word = np.mean([net.p["word"][zlib.crc32(w.encode()) % H.WORD_BUCKETS] for w in words], axis=0)
            stops = sum(b.text.count(s) for s in ".,!?")
            xs.append(np.concatenate([path, word, [np.log(1 + n) / 6, np.log(1 + len(words)) / 5, b.linked / n, stops / len(words), k / len(blocks), seen / total, b.depth / 10, n / total]]))
            seen += n
        both = zip(lstm("f", xs), reversed(lstm("b", xs[::-1])))
        return [float((np.concatenate(hs) @ net.p["out"])[0] + net.p["bias"][0]) > 0 for hs in both]

    assert [x.tolist() for x in net.label(pages)] == [plain(p) for p in pages]


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "", 2), (2, "u", "<p>", 3), (2, "u", "<p>", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = H.main_text(df).collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0)] * 4
    assert H.main_text(df.limit(0)).count() == 0
