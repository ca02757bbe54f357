"""Operator 9, HTML extraction: boosted trees over DOM-node features and a decoding that respects the tree.

A page is read into a tree of block elements whose leaves are runs of inline text. Every node gets a probability to hold main text.
A node can only be chosen if its parent is; among all choices that hold to this the most probable is taken, by one pass up and one down
the tree. The text is the chosen runs in page order. The trees are trained on made-up pages (`html_pages`), as pages have no labels.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolspark.llm import gbt
from toolspark.llm.common import read, refuse
from toolspark.llm.html_pages import pages

TRAIN_PAGES = 700
SEED = 9
#: fixed values: elements by their part in the tree
INLINE = frozenset("a b i em strong span small big code sub sup u s del ins mark font abbr acronym cite q time label bdi bdo dfn kbd samp var tt data ruby rt rp wbr br img picture x-main math mi mn mo mrow mtext msup msub msubsup mfrac msqrt mroot mover munder mspace".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea select option button title head canvas audio video map".split())
#: fixed values: elements whose content is no markup, so that one left open goes to the end of the page
PLAIN = frozenset("script style textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd tr td th".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
WALLS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "p": ("div", "article", "section", "td", "li", "blockquote", "body", "main", "aside", "footer", "header", "nav", "form")}
TAGS = ["run", "p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "h1", "h2", "table", "td", "blockquote", "pre", "body"]
GOOD_WORDS = re.compile(r"article|post|content|entry|main|story|body|text|prose|markdown|copy")
BAD_WORDS = re.compile(r"nav|menu|header|masthead|banner|logo|brand|foot|copyright|legal|colophon|bottom|side|aside|widget|relat|recommend|trend|popular|tag|promo|more|sponsor|cookie|consent|gdpr|alert|notice|modal|popup|overlay|subscri|newsletter|paywall|share|social|follow|crumb|topbar|pagin|toc|login|search|tool|(?<![a-z])ad(?:s|vert\w*)?(?![a-z])")
COMMENT_WORDS = re.compile(r"comment|disqus|discuss|repl(?:y|ies)|respon[sd]")

_start = re.compile(r"</?[a-zA-Z][^\s/>]*")
_stop = re.compile("[>\"']")
_names = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_hidden = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


class Tree:
    """Nodes in page order; node 0 is the page. Leaves with text are runs."""

    __slots__ = ("attrs", "children", "depth", "links", "main", "parent", "tag", "text")

    def __init__(self) -> None:
        self.parent, self.tag, self.attrs, self.depth = [-1], ["body"], [""], [0]
        self.text: list[str] = [""]
        self.links, self.main, self.children = [0], [False], [0]

    def add(self, parent: int, tag: str, attrs: str, text: str = "", links: int = 0, main: bool = False) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.depth.append(self.depth[parent] + 1)
        self.text.append(text)
        self.links.append(links)
        self.main.append(main)
        self.children.append(0)
        self.children[parent] += 1
        return len(self.tag) - 1


class Tags:
    """Reads a page from mark to mark, in time linear in its length: what was once looked for in vain is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.at, self.plain, self.lost = page, 0, False, set()
        self.last = {q: page.rfind(q) for q in "\"'"}

    def _end(self, at: int) -> int:
        """Index of the > that ends the tag; a > in quotes does not, unless that leaves the tag without an end. -1: no > is left."""
        i, page = at, self.page
        while not self.plain and (m := _stop.search(page, i)):
            if m[0] == ">":
                return m.start()
            # a quote that nothing closes is a character like any other
            i = page.find(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
        self.plain = True
        return page.find(">", at)

    def __iter__(self):
        """(text before, name or None, is an end tag, attributes); the last has no name. A comment, declaration or CDATA section has none either."""
        page, begun = self.page, 0
        while True:
            a = page.find("<", self.at)
            if a < 0:
                yield page[begun:], None, False, ""
                return
            if page.startswith("<!--", a):
                z = page.find("-->", a + 4)
                z = len(page) if z < 0 else z + 3
            elif page.startswith("<![CDATA[", a):
                z = page.find("]]>", a)
                yield page[begun:a] + html.escape(page[a + 9 : z if z >= 0 else len(page)]), None, False, ""
                begun = self.at = len(page) if z < 0 else z + 3
                continue
            elif page.startswith(("<!", "<?"), a):
                z = page.find(">", a)
                z = len(page) if z < 0 else z + 1
            elif m := _start.match(page, a):
                z = self._end(m.end())
                if z < 0:  # the page ends inside a tag
                    yield page[begun:a], None, False, ""
                    return
                self.at = z + 1
                yield page[begun:a], m[0].lstrip("</").lower(), m[0][1] == "/", page[m.end() : z]
                begun = self.at  # after the tag, or where skip() went
                continue
            else:
                self.at = a + 1
                continue
            yield page[begun:a], None, False, ""
            begun = self.at = z

    def skip(self, tag: str) -> bool:
        """Goes on after the element's end tag; False if there is none."""
        m = None if tag in self.lost else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, self.at)
        if m is None:
            self.lost.add(tag)
            return False
        self.at = m.end()
        return True


def parse(page: str) -> Tree:
    """Never fails: unknown end tags are dropped, what is open at the end is closed, a tag that the page breaks off is dropped."""
    t = Tree()
    stack, names, open_ = [0], ["body"], Counter()
    pieces: list[str] = []
    links = anchor = main = run_main = 0

    def flush() -> None:
        nonlocal links, run_main
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                t.add(stack[-1], "run", "", text, min(links, len(text)), run_main > 0)
            pieces.clear()
        links = run_main = 0

    def cut(i: int) -> None:
        """Closes the elements from the i-th open one on."""
        open_.subtract(names[i:])
        del names[i:], stack[i:]

    tags = Tags(page)
    for text, tag, end, attrs in tags:
        if text:
            pieces.append(text)
            if not text.isspace():
                run_main = run_main or main
            if anchor:
                links += len(text)
        if tag is None:
            continue
        if tag == "x-main":
            main += -1 if end else 1
        if tag in RAW and not end:
            if attrs.endswith("/"):
                continue
            if not tags.skip(tag):
                if tag in PLAIN:
                    break
                continue
            if tag not in ("option", "select", "button") and pieces:
                pieces.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                anchor = 0 if end else 1
            elif tag in ("br", "wbr") and not end:
                pieces.append(" ")
            continue
        if tag in ("html", "body", "head") or tag in RAW:
            if tag == "body" and not end:
                t.attrs[0] = attrs
            continue
        flush()
        if end:
            if open_[tag] > 0:
                i = len(names) - 1
                while names[i] != tag:
                    i -= 1
                cut(i)
            continue
        if tag in CLOSES_P and open_["p"] > 0:
            i = len(names) - 1
            while i and names[i] not in WALLS["p"] and names[i] != "p":
                i -= 1
            if i and names[i] == "p":
                cut(i)
        same = SAME.get(tag, ())
        if tag != "p" and any(open_[x] > 0 for x in same):
            i = len(names) - 1
            while i and names[i] not in WALLS[tag] and names[i] not in same:
                i -= 1
            if i and names[i] in same:
                while i and names[i - 1] in same:
                    i -= 1
                cut(i)
        if tag in VOID or attrs.endswith("/"):
            continue
        stack.append(t.add(stack[-1], tag, attrs))
        names.append(tag)
        open_[tag] += 1
        anchor = 0
    flush()
    return t


@lru_cache(65536)
def attr_marks(tag: str, attrs: str) -> tuple[float, float, float, float]:
    """Hits of good, bad and comment words in class, id and role, and whether the element is hidden."""
    if not attrs:
        return 0.0, 0.0, 0.0, 0.0
    words = " ".join(a or b or c for a, b, c in _names.findall(attrs)).lower()
    return float(bool(GOOD_WORDS.search(words))), float(bool(BAD_WORDS.search(words))), float(bool(COMMENT_WORDS.search(words))), float(bool(_hidden.search(attrs)))


def node_features(t: Tree) -> np.ndarray:
    n = len(t.tag)
    parent = np.array(t.parent)
    depth = np.array(t.depth, float)
    size = np.array([len(x) for x in t.text], float)
    own_words = np.array([x.count(" ") + 1 if x else 0 for x in t.text], float)
    links = np.array(t.links, float)
    marks = np.array([sum(x.count(c) for c in ".,;:!?") for x in t.text], float)
    copy = np.array(["©" in x or "copyright" in x.lower() for x in t.text], float)
    run = np.array([x == "run" for x in t.tag], float)
    para = np.array([x == "p" for x in t.tag], float)
    total = np.stack([size, own_words, links, marks, run, para, np.ones(n), copy], 1)
    for i in range(n - 1, 0, -1):
        total[t.parent[i]] += total[i]
    attrs = np.array([attr_marks(g, a) for g, a in zip(t.tag, t.attrs, strict=True)])
    index = {g: k for k, g in enumerate(TAGS)}
    code = np.array([index.get("h2" if g in ("h3", "h4", "h5", "h6") else "ul" if g in ("ol", "dl") else "td" if g == "th" else g, -1) for g in t.tag])
    onehot = np.zeros((n, len(TAGS)))
    known = code >= 0
    onehot[np.flatnonzero(known), code[known]] = 1
    # what stands above: the worst and best names, and the kinds of the ancestors
    above = np.zeros((n, 8))
    kinds = {"nav": 4, "header": 4, "footer": 4, "aside": 4, "form": 5, "article": 6, "main": 6}
    own = np.zeros((n, 8))
    own[:, :4] = attrs
    for i, g in enumerate(t.tag):
        if g in kinds:
            own[i, kinds[g]] = 1
        if g in ("li", "ul", "ol"):
            own[i, 7] = 1
    for i in range(1, n):
        p = t.parent[i]
        above[i] = np.maximum(above[p], own[p])
    # siblings
    place = np.zeros(n)
    seen = np.zeros(n)
    for i in range(1, n):
        place[i] = seen[t.parent[i]]
        seen[t.parent[i]] += 1
    sisters = np.array(t.children, float)[np.maximum(parent, 0)]
    around = total[np.maximum(parent, 0)]
    before = np.cumsum(size) - size
    whole = np.maximum(total[0], 1)
    chars = np.maximum(total[:, 0], 1)
    article_page = float("article" in t.tag or "main" in t.tag)
    extra = np.stack(
        [
            depth, np.log1p(total[:, 0]), np.log1p(total[:, 1]), total[:, 2] / chars, total[:, 3] / np.maximum(total[:, 1], 1), total[:, 0] / np.maximum(total[:, 4], 1), total[:, 0] / np.maximum(total[:, 6], 1),
            total[:, 5], total[:, 0] / whole[0], before / whole[0], place, place / np.maximum(sisters, 1), np.log1p(sisters), total[:, 0] / np.maximum(around[:, 0], 1), around[:, 2] / np.maximum(around[:, 0], 1), around[:, 5],
            total[:, 7] > 0, np.full(n, article_page),
        ],
        1,
    )
    parent_tag = code[np.maximum(parent, 0)].astype(float)
    return np.concatenate([above, own, onehot, extra, parent_tag[:, None]], 1)


#: Features in which the probability may only rise or fall: good, bad, comment words and hiding, above a node and on it, and kinds of boilerplate above.
MONOTONE = {0: 1, 1: -1, 2: -1, 3: -1, 4: -1, 5: -1, 6: 1, 8: 1, 9: -1, 10: -1, 11: -1, 12: -1, 13: -1, 14: 1}


def decode(parent: list[int], p: np.ndarray) -> np.ndarray:
    """The most probable set of nodes in which every node's parent is too."""
    n = len(parent)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    take, skip = yes[:], no[:]
    for i in range(n - 1, 0, -1):
        up = parent[i]
        take[up] += take[i] if take[i] > skip[i] else skip[i]
        skip[up] += skip[i]
    out = np.zeros(n, bool)
    out[0] = take[0] > skip[0]
    for i in range(1, n):
        out[i] = out[parent[i]] and take[i] > skip[i]
    return out


@lru_cache(2)
def train(n: int = TRAIN_PAGES, seed: int = SEED) -> gbt.Trees:
    x, y = [], []
    for page in pages(n, seed):
        t = parse(page)
        main = list(t.main)
        for i in range(len(main) - 1, 0, -1):
            main[t.parent[i]] = main[t.parent[i]] or main[i]
        x.append(node_features(t))
        y.append(np.array(main, float))
    return gbt.fit(np.concatenate(x), np.concatenate(y), MONOTONE, trees=60, depth=5, rate=0.25, bins=32)


def texts(sources: list[str], model: gbt.Trees) -> list[list[str]]:
    """The chosen runs of each page."""
    trees = [parse(s) for s in sources]
    if not trees:
        return []
    x = np.concatenate([node_features(t) for t in trees])
    p = model.probability(x)
    out, at = [], 0
    for t in trees:
        n = len(t.tag)
        chosen = decode(t.parent, p[at : at + n])
        at += n
        out.append([t.text[i] for i in np.flatnonzero(chosen) if t.text[i]])
    return out


def extracted(table: DataFrame, model: gbt.Trees | None = None, html_col: str = "html", out_col: str = "text_") -> DataFrame:
    """table with a string column of the main text: runs joined by an empty line. Null or empty pages, and pages without main text: empty text. Pages are read
    whole, each for itself, so repeated rows get equal texts and an empty table gives an empty one. Other columns pass through; a column named as the new one is refused."""
    refuse(table, out_col)
    import pandas as pd

    model = model or train()

    def main_text(pages_):
        out: list[str] = []
        held: list[str] = []
        size = 0
        for s in [*pages_, None]:
            if s is None or size > 2 << 20:
                out += ["\n\n".join(r) for r in texts(held, model)]
                held, size = [], 0
            if s is not None:
                held.append(s)
                size += len(s)
        return pd.Series(out)

    main_text.__annotations__ = {"pages_": pd.Series, "return": pd.Series}
    return table.withColumn(out_col, F.pandas_udf(main_text, "string")(F.coalesce(F.col(html_col), F.lit(""))))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("text_").alias("text"), F.length("text_").cast("long").alias("n_chars"))
