"""Made pages whose main text is known: texts of real pages set into many layouts, each drawn from a fixed seed."""

from __future__ import annotations

import html as references
import random

PAGES = 900
SEED = 20240305

# Marks of the containers in made pages.
MAIN = ["article", 'div class="content"', 'div class="post-content"', 'div class="entry-content"', 'div id="main"', 'main', 'div class="article-body"', 'div id="story"',
        'section class="post"', 'div', 'section', 'div class="text"', 'div class="page-content"', 'div itemprop="articleBody"', 'div class="col-8"', 'div class="wrapper"', "article", "article"]
MENU = ["nav", "nav", "nav", 'div class="nav"', 'ul class="menu"', 'div id="menu"', 'div class="navbar"', 'div class="breadcrumbs"', 'div class="pagination"', 'div role="navigation"', "div"]
HEAD = ["header", "header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'div role="banner"']
FOOT = ["footer", "footer", "footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"']
SIDE = ["aside", 'aside class="sidebar"', 'div class="sidebar"', 'div id="side"', 'div class="widget"', 'div class="related"', 'section class="recommended"', 'div class="right-rail"', 'div role="complementary"']
NOTICE = ['div class="cookie-notice"', 'div id="cookies"', 'div class="notice"', 'div class="alert"', 'div class="consent"', 'div class="gdpr-banner"', 'section class="notice"', 'p class="notice"',
          'div class="modal"', 'div role="alert"']
ADVERT = ['div class="ad"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="ad-1"', 'div class="sponsored"', 'div class="promo"', 'div class="banner-ad"', 'aside class="advertisement"', 'p class="ad"']
FORM = ["form", 'form class="newsletter"', 'form id="search"', 'div class="subscribe"', 'div class="login"', 'div class="signup-form"', 'div class="share"', 'div class="social-links"']
COMMENT = ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'section class="comments"', 'div id="disqus_thread"', 'div class="replies"', 'div id="respond"']


class _Maker:
    def __init__(self, texts: list[str], draw: random.Random):
        self.texts, self.draw, self.truth = texts, draw, set()
        self.short = [t for t in texts if len(t) < 40] or texts
        self.used: set[str] = set()

    def words(self, short: bool = False) -> str:
        """A text that this page does not hold yet, so that every text has one label."""
        for _ in range(20):
            text = self.draw.choice(self.short if short else self.texts)
            if self.draw.random() < 0.4:
                parts = text.split()
                text = " ".join(parts[:self.draw.randint(1, max(1, len(parts)))])
            text = " ".join(text.split())
            if text and text not in self.used:
                self.used.add(text)
                return text
        text = f"{text} {len(self.used)}"
        self.used.add(text)
        return text

    def main(self, short: bool = False) -> str:
        text = self.words(short)
        self.truth.add(text)
        return self.inline(text, 0.03)

    def inline(self, text: str, share: float) -> str:
        """Markup inside a block, which does not change its text."""
        parts = [references.escape(w) for w in text.split(" ")]
        for i in range(len(parts)):
            if self.draw.random() < share:
                parts[i] = self.draw.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(parts[i])
        return " ".join(parts)

    def put(self, mark: str, inner: str) -> str:
        return f"<{mark}>{inner}</{mark.split()[0]}>"

    def links(self, n: int) -> str:
        rows = "".join(f'<li><a href="/{i}">{references.escape(self.words(True))}</a></li>' for i in range(n))
        return f"<ul>{rows}</ul>" if self.draw.random() < 0.75 else rows.replace("<li>", "").replace("</li>", " ")

    def prose(self, n: int) -> str:
        if self.draw.random() < 0.3:
            return self.inline(self.words(), 0.02)
        return "".join(self.put("p", self.inline(self.words(), 0.02)) for _ in range(n))

    def article(self) -> str:
        draw, out = self.draw, []
        if draw.random() < 0.75:
            heading = self.put("h1", self.main(True))
            out.append(self.put("header", heading) if draw.random() < 0.15 else heading)
        if draw.random() < 0.25:
            title = self.words()
            self.truth.add(title)
            out.append(f"<p><b>{references.escape(title)}<br>")
        for _ in range(draw.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
            roll = draw.random()
            if roll < 0.74:
                out.append(self.put("p", self.main(draw.random() < 0.25)) if draw.random() < 0.9 else f"<p>{self.main()}")
            elif roll < 0.80:
                out.append(self.put(draw.choice(["h2", "h3"]), self.main(True)))
            elif roll < 0.85:
                out.append(self.put(draw.choice(["ul", "ol"]), "".join(self.put("li", self.main(draw.random() < 0.5)) for _ in range(draw.randint(1, 6)))))
            elif roll < 0.88:
                out.append(self.put("blockquote", self.put("p", self.main())))
            elif roll < 0.90:
                out.append(self.put("pre", self.main()))
            elif roll < 0.92:
                out.append(self.put("table", "".join(self.put("tr", "".join(self.put("td", self.main(True)) for _ in range(2))) for _ in range(draw.randint(1, 4)))))
            elif roll < 0.94:
                out.append(self.put("figure", f'<img src="x.png">{self.put("figcaption", self.main(True))}'))
            elif roll < 0.96:
                out.append(self.put("div", self.main()))
            else:
                out.append(draw.choice([self.advert, self.form, self.side, self.notice])())
        if not self.truth:
            out.append(self.put("p", self.main()))
        if draw.random() < 0.08:
            out.append(self.comments())
        return "".join(out)

    def advert(self) -> str:
        return self.put(self.draw.choice(ADVERT), self.prose(1))

    def notice(self) -> str:
        return self.put(self.draw.choice(NOTICE), self.inline(self.words(), 0.05))

    def form(self) -> str:
        return self.put(self.draw.choice(FORM), f"<label>{references.escape(self.words(True))}</label><input name=q><button>{references.escape(self.words(True))}</button>")

    def side(self) -> str:
        inner = self.put("h3", references.escape(self.words(True))) if self.draw.random() < 0.5 else ""
        return self.put(self.draw.choice(SIDE), inner + (self.links(self.draw.randint(2, 7)) if self.draw.random() < 0.6 else self.prose(self.draw.randint(1, 3))))

    def menu(self) -> str:
        return self.put(self.draw.choice(MENU), self.links(self.draw.randint(2, 9)))

    def head(self) -> str:
        inner = self.put(self.draw.choice(["h1", "p", "div", "span"]), references.escape(self.words(True)))
        return self.put(self.draw.choice(HEAD), inner + (self.menu() if self.draw.random() < 0.4 else ""))

    def foot(self) -> str:
        text = f"&copy; {references.escape(self.words(True))} &middot; {references.escape(self.words())}" if self.draw.random() < 0.7 else self.inline(self.words(), 0.1)
        return self.put(self.draw.choice(FOOT), (self.put("p", text) if self.draw.random() < 0.4 else text) + (self.links(3) if self.draw.random() < 0.3 else ""))

    def comments(self) -> str:
        one = [self.put(self.draw.choice(["li", "div", 'div class="comment"', "article", 'article class="comment"']), self.put("p", self.inline(self.words(), 0.02))) for _ in range(self.draw.randint(1, 6))]
        return self.put(self.draw.choice(COMMENT), (self.put("h3", references.escape(self.words(True))) if self.draw.random() < 0.5 else "") + "".join(one))

    def page(self) -> str:
        draw = self.draw
        mark = draw.choice(MAIN)
        main = self.put(mark, self.article())
        for _ in range(draw.choice([0, 0, 1, 2])):
            main = self.put(draw.choice(["div", "main", 'div class="container"', 'div id="page"', "section", 'div class="row"']), main + (self.side() if draw.random() < 0.2 else ""))
        before, after = [], []
        for part, share, places in ((self.notice, 0.2, (before, after)), (self.head, 0.45, (before,)), (self.menu, 0.8, (before,)), (self.form, 0.25, (before, after)),
                                    (self.advert, 0.6, (before, after)), (self.advert, 0.2, (before, after)), (self.side, 0.4, (before, after)), (self.comments, 0.3, (after,)), (self.foot, 0.85, (after,))):
            if draw.random() < share:
                draw.choice(places).append(part())
        title = f"<head><title>{references.escape(draw.choice(self.texts))}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        return f"<!DOCTYPE html><html>{title}<body>{''.join(before)}<!-- x -->{main}{''.join(after)}" + ("</body></html>" if draw.random() < 0.9 else "")


def made_pages(texts: list[str], count: int = PAGES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """Pages and the set of their main texts; the same texts give the same pages."""
    if not texts:
        return []
    draw, out = random.Random(seed), []
    for _ in range(count):
        maker = _Maker(texts, draw)
        out.append((maker.page(), maker.truth))
    return out
