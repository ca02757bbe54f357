"""Made-up web pages with known main text, on which the extraction trees of `html_text` are trained. Deterministic for a seed."""

from __future__ import annotations

import random

_syllables = "an be co da el fi go ha in jo ka le mo ne or pa ra si to un ve wi xa yo ze th er ion ing".split()
#: fixed values: names that page authors give to parts of a page
GOOD = ["article", "post", "content", "entry-content", "main", "story", "article-body", "post-content", "text", "body-copy", "entry", "page-content", "markdown-body", "prose"]
BAD = {
    "nav": ["nav", "menu", "navbar", "main-nav", "breadcrumb", "breadcrumbs", "topbar", "site-nav", "pagination", "toc"],
    "header": ["header", "site-header", "masthead", "banner", "logo", "branding"],
    "footer": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular-posts", "tags", "promo", "more-stories"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "ad-slot", "promo-box", "banner-ad"],
    "notice": ["cookie", "cookie-notice", "consent", "gdpr", "alert", "notice", "modal", "popup", "overlay", "subscribe", "newsletter", "paywall"],
    "comments": ["comments", "comment-list", "comment", "disqus", "discussion", "replies", "responses"],
    "share": ["share", "social", "share-buttons", "social-links", "follow-us", "byline-tools"],
}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.texts: list[str] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        out[0] = out[0].title()
        for i in range(len(out) - 1):
            if r.random() < 0.1:
                out[i] += r.choice([",", ".", ";", "."])
        if r.random() < 0.15:
            out[r.randrange(len(out))] += r.choice(["***", " |", "%%%", "!!", "###"])
        return " ".join(out) + ("." if len(out) > 6 else "")

    def attr(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        name = r.choice(names) + r.choice(["", "", "", "-1", " clearfix", " col-4", " block"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int) -> str:
        r = self.r
        kind = r.choice(["li", "li", "a", "div"])
        items = [f'<a href="/{i}">{self.words(1, r.choice([2, 3, 8]))}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>" if kind == "li" else "".join(f"<div>{a}</div>" for a in items) if kind == "div" else " | ".join(items)

    def wrap(self, tags: list[str], names: list[str], inside: str) -> str:
        t = self.r.choice(tags)
        return f"<{t}{self.attr(names)}>{inside}</{t}>"

    def boiler(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.wrap(["nav", "nav", "div"], BAD["nav"], self.links(r.randint(3, 12)))
        if kind == "header":
            return self.wrap(["header", "header", "div"], BAD["header"], r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 4)}</div>", f'<a href="/">{self.words(1, 3)}</a>']) + r.choice(["", self.boiler("nav"), f"<p>{self.words(3, 9)}</p>"]))
        if kind == "footer":
            return self.wrap(["footer", "footer", "div"], BAD["footer"], r.choice([f"&copy; {self.words(2, 5)} {self.words(6, 30)}", f"<p>&copy; 2024 {self.words(2, 20)}</p>", self.links(r.randint(3, 9)) + f"<p>{self.words(4, 15)}</p>", f"{self.words(3, 25)}\n{self.words(1, 5)}"]))
        if kind == "side":
            return self.wrap(["aside", "aside", "div", "section"], BAD["side"], f"<h3>{self.words(1, 4)}</h3>" + r.choice([self.links(r.randint(2, 8)), f"<p>{self.words(5, 40)}</p>", self.links(3) + f"<p>{self.words(5, 30)}</p>"]))
        if kind == "ad":
            tag, long = r.choice(["div", "div", "div", "aside", "section"]), r.choice([6, 15, 40, 120])
            return f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(BAD["ad"])}">{r.choice([self.words(2, long), self.words(2, long), "<p>" + self.words(2, long) + "</p>", "<a href=/x>" + self.words(2, 15) + "</a>"])}</{tag}>'
        if kind == "notice":
            return f'<div {r.choice(["class", "id"])}="{r.choice(BAD["notice"])}">{r.choice(["<p>" + self.words(8, 40) + "</p>", self.words(8, 40)])}<button>{self.words(1, 2)}</button></div>'
        if kind == "comments":
            one = lambda: f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><b>{self.words(1, 2)}</b><p>{self.words(4, 60)}</p></div>' if r.random() < 0.7 else f"<li><p>{self.words(4, 60)}</p></li>"
            return f'<{(t := r.choice(["section", "div", "div"]))} {r.choice(["class", "id"])}="{r.choice(BAD["comments"])}"><h3>{self.words(1, 3)}</h3>{"".join(one() for _ in range(r.randint(1, 8)))}</{t}>'
        if kind == "form":
            return f'<form action="/s"><label>{self.words(1, 4)}</label><input name="q"><p>{self.words(2, 12)}</p><button>{self.words(1, 2)}</button></form>'
        return self.wrap(["div", "ul"], BAD["share"], self.links(r.randint(2, 5)))

    def part(self) -> str:
        """A block of main text."""
        r, x = self.r, self.r.random()
        if x < 0.62:
            text = self.words(1, r.choice([4, 30, 80, 160]))
            if r.random() < 0.2:
                text = f"<b>{text}" + r.choice(["</b>", "<br>"])
            if r.random() < 0.25:
                text += f' <a href="/w">{self.words(1, 3)}</a> {self.words(2, 20)}'
            return f"<p>{text}" + ("</p>" if r.random() < 0.9 else "")
        if x < 0.72:
            return f"<h{r.choice('23')}>{self.words(1, 7)}</h{2}>"
        if x < 0.8:
            return "<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if x < 0.84:
            return "<ol>" + "".join(f"<li><p>{self.words(5, 30)}</p></li>" for _ in range(r.randint(2, 5))) + "</ol>"
        if x < 0.9:
            return f"<blockquote>{r.choice([self.words(5, 40), '<p>' + self.words(5, 40) + '</p>'])}</blockquote>"
        if x < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if x < 0.96:
            return f"<pre>{self.words(3, 20)}\n  {self.words(3, 20)}</pre>"
        return f"<div>{self.words(5, 80)}</div>"

    def page(self) -> str:
        """Main text is marked by the tag <x-main>, which the trainer strips."""
        r = self.r
        inner = []
        if r.random() < 0.85:
            inner.append(f"<h1>{self.words(2, 12)}</h1>")
        for _ in range(r.choice([0, 0, 1, 2, 4, 8, 16])):
            inner.append(self.part())
        if r.random() < 0.2:  # a text that says the same again and again
            again = self.words(1, 6)
            inner += [f"<p>{'<b>' * (r.random() < 0.2)}{again}</p>" for _ in range(r.randint(2, 20))]
        inner.append(f"<p>{self.words(1, r.choice([4, 20, 90]))}</p>")
        holes = [self.boiler(k) for k in ("ad", "share", "side", "notice", "comments", "form", "ad", "ad", "nav") if r.random() < 0.13]
        for h in holes:
            inner.insert(r.randint(1, len(inner)), f"</x-main>{h}<x-main>")
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        name = f' class="{r.choice(GOOD)}"' if r.random() < (0.85 if tag in ("div", "section") else 0.35) else ""
        main = f"<{tag}{name}><x-main>{''.join(inner)}</x-main></{tag}>"
        if tag == "td":
            main = f"<table><tr>{main}<td>{self.links(5)}</td></tr></table>"
        if r.random() < 0.3:
            main = f'<div{self.attr(["container", "wrapper", "page", "row", "layout"])}>{main}{self.boiler("side") if r.random() < 0.6 else ""}</div>'
        top = [self.boiler(k) for k in ("header", "nav", "notice", "nav", "ad", "form") if r.random() < 0.5]
        end = [self.boiler(k) for k in ("comments", "side", "share", "notice", "footer", "ad", "form") if r.random() < 0.4]
        if r.random() < 0.5:
            end.append(self.boiler("footer"))
        return f"<html><head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>{''.join(top)}{main}{''.join(end)}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
