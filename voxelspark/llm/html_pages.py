"""Made-up web pages with known main text: what the block labeller learns from.

Layouts, class names and the words of page furniture vary; prose is random syllables, so that a text's
words tell little and its place in the document tells much. Every page is made from a seed.
"""

from __future__ import annotations

import random

#: Words of page furniture in the languages of the pages.
FURNITURE = {
    "nav": "home about contact news archive topics login search help blog shop products services team careers menu start kontakt über accueil inicio contacto".split(),
    "footer": "copyright © 2021 2024 all rights reserved privacy policy terms imprint impressum sitemap powered by legal mentions légales aviso".split(),
    "ad": "advertisement sponsored buy now sale offer discount free shipping deal limited price order today anzeige publicité anuncio".split(),
    "notice": "we use cookies to improve your experience accept decline settings consent subscribe notice alert gdpr".split(),
    "form": "name email message send submit subscribe newsletter your address password sign up register search".split(),
    "side": "related articles popular posts recent tags categories follow us share tweet trending more stories also read recommended".split(),
    "comment": "reply posted by says ago comment great thanks i agree disagree lol nice post upvote report user".split(),
}
SYLLABLES = "th er on an re he in ed nd ha at en es of nt ea ti to it st io le is ou ar as de rt ve ß ü ö ch sch ei ung eau é è ç que ment ción ñ ó la do ll rr".split()
#: Containers of the main text, and tags and class names of furniture.
MAIN = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'div class="entry-content"', 'section class="article-body"', 'div class="story"', 'div class="text"', "article class='post'", 'div role="main"', "div"]
BOXES = {
    "nav": ["nav", "header", 'div class="menu"', 'div id="nav"', 'ul class="navbar"', 'div class="breadcrumb"', 'div class="topbar"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="site-title"', 'div class="logo"', 'div class="branding"'],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', "section class='site-info'"],
    "ad": ['div class="ad"', 'div class="advert"', 'div class="sponsored"', 'aside class="promo"', 'div id="banner-ad"', 'div class="ads"', 'ins class="adsbygoogle"'],
    "notice": ['div class="cookie"', 'div class="notice"', 'div id="cookie-banner"', 'div class="alert"', 'div class="consent popup"', 'div role="alert"'],
    "form": ["form", 'form class="newsletter"', 'div class="signup"', 'form id="search"', 'div class="login-form"'],
    "side": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'section class="widget"', 'div class="share"', 'div class="tags"'],
    "comment": ['section id="comments"', 'div class="comments"', 'ol class="comment-list"', 'div class="reader-comments"', 'div class="discussion"', 'div class="replies"'],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.truth: list[tuple[str, bool]] = []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice([1, 1, 2, 2, 3])))

    def prose(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        words = [self.word() + (self.r.choice([".", ","]) if self.r.random() < 0.15 else "") for _ in range(n)]
        words[0] = words[0].capitalize()
        if self.r.random() < 0.06:
            words = words[: self.r.choice([1, 2])] * self.r.choice([3, 20, 60])
        if self.r.random() < 0.1:
            words = [w + " |" for w in words]
        elif self.r.random() < 0.05:
            words = [w + self.r.choice(["###", "$$$", "%%%"]) for w in words]
        return " ".join(words) + self.r.choice([".", ".", "", "!"])

    def furniture(self, kind: str, low: int = 1, high: int = 6) -> str:
        words = FURNITURE.get(kind, FURNITURE["nav"])
        share = self.r.choice([0.0, 0.3, 0.8])
        return " ".join(self.r.choice(words) if self.r.random() < share else self.word() for _ in range(self.r.randint(low, high)))

    def leaf(self, text: str, main: bool) -> str:
        """Each leaf's text starts with a mark, so that blocks find their label whatever the parser does."""
        self.truth.append((text, main))
        return f"\x02{len(self.truth) - 1}\x03{text}"

    def box(self, kind: str) -> str:
        r = self.r
        open_ = r.choice(BOXES[kind]) if r.random() < 0.9 else "div"
        name = open_.split()[0]
        link = lambda t: f'<a href="/{r.randint(0, 99)}">{t}</a>'
        if kind == "nav" or (kind == "side" and r.random() < 0.6):
            items = [f"<li>{link(self.leaf(self.furniture(kind, 1, 3 if kind == 'nav' else 8), False))}</li>" for _ in range(r.randint(2, 8))]
            body = f"<ul>{''.join(items)}</ul>"
        elif kind == "form":
            body = "".join(f"<label>{self.leaf(self.furniture(kind, 1, 3), False)}</label><input name=x>" for _ in range(r.randint(1, 3))) + f"<button>{self.leaf(self.furniture(kind, 1, 2), False)}</button>"
        elif kind == "comment":
            body = "".join(
                f'<div class="{r.choice(["comment", "reply", "c-body", "item"])}"><span class="author">{self.leaf(self.word(), False)}</span><p>{self.leaf(self.prose(4, 40) if r.random() < 0.7 else self.furniture(kind, 3, 12), False)}</p></div>'
                for _ in range(r.randint(1, 5))
            )
        elif kind == "header":
            name = r.choice(["h1", "div", "div", "p"])
            body = f"<{name}>{self.leaf(self.furniture('nav', 1, 4), False)}</{name}>"
            name = open_.split()[0]
        else:
            text = self.prose(3, 25) if r.random() < 0.6 else self.furniture(kind, 2, 12)
            body = self.leaf(text, False) if r.random() < 0.6 else f"<p>{self.leaf(text, False)}</p>"
        return f"<{open_}>{body}</{name}>"

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{self.leaf(self.prose(3, 12), True)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            kind = r.random()
            if kind < 0.7:
                low, high = r.choice([(1, 3), (4, 15), (15, 80)])
                text = f"<p>{'<b>' if r.random() < 0.15 else ''}{self.leaf(self.prose(low, high), True)}"
                text += f"<br>{self.leaf(self.prose(2, 20), True)}" if r.random() < 0.1 else ""
                out.append(text + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.76:
                out.append(f"<h{r.randint(2, 4)}>{self.leaf(self.prose(2, 8), True)}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.leaf(self.prose(2, 15), True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{self.leaf(self.prose(5, 30), True)}</blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{self.leaf(self.prose(1, 4), True)}</td><td>{self.leaf(self.prose(1, 4), True)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.93:
                out.append(f"<pre>{self.leaf(self.prose(3, 20), True)}</pre>")
            else:
                out.append(self.box(r.choice(["ad", "side", "notice", "form"])))
        if r.random() < 0.08:
            out.append(self.box("comment"))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        head = f"<head><meta charset=utf-8><title>{self.leaf(self.prose(2, 10), False)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        before = [self.box(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.35]
        r.shuffle(before)
        open_ = r.choice(MAIN)
        main = f"<{open_}>{self.article()}</{open_.split()[0]}>"
        if r.random() < 0.3:
            main = f'<div class="{r.choice(["wrap", "container", "page", "row"])}">{main}{self.box("side") if r.random() < 0.5 else ""}</div>'
        after = [self.box(k) for k in ("comment", "side", "ad", "form", "nav", "notice") if r.random() < 0.3]
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.box("footer"))
        end = "</body></html>" if r.random() < 0.7 else ""
        return f"<!DOCTYPE html><html lang=en>{head}<body>{''.join(before)}<!-- x -->{main}{''.join(after)}{end}"


def made(seed: int) -> tuple[str, list[bool]]:
    """(html with marked leaves, label of each leaf)."""
    maker = Maker(seed)
    html = maker.page()
    return html, [main for _, main in maker.truth]
