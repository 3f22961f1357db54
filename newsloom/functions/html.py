"""HTML extraction with the standard parser, as Arrow UDFs: paragraphs of an article, links, trending repositories.

Nothing recurses, and a node's text is a slice of the page's pieces of text, so pages of any nesting are read in time near their length.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP = {"script", "style", "nav", "header", "footer", "aside", "iframe", "noscript"}
BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li"}
CLOSES_P = BLOCK | {"div", "article", "section", "ul", "ol", "table", "main", "blockquote", "pre", "hr", "form"}


class Node:
    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def steps(self):
        """(node or text, whether it's left) below this one, in document order."""
        stack = [iter(self.kids)]
        path = [self]
        while stack:
            k = next(stack[-1], None)
            if k is None:
                stack.pop()
                n = path.pop()
                if n is not self:
                    yield n, True
            elif isinstance(k, str):
                yield k, False
            else:
                yield k, False
                stack.append(iter(k.kids))
                path.append(k)

    def text(self) -> str:
        return "".join(k for k, _ in self.steps() if isinstance(k, str))

    def walk(self):
        return (k for k, left in self.steps() if not left and not isinstance(k, str))

    def texts(self, tags: set[str]):
        """The texts of the nodes below of these tags, in document order of their beginnings, each made when it's asked for."""
        pieces, found, open_at = [], [], {}
        for k, left in self.steps():
            if isinstance(k, str):
                pieces.append(k)
            elif k.tag in tags:
                if left:
                    found[open_at.pop(id(k))][1] = len(pieces)
                else:
                    open_at[id(k)] = len(found)
                    found.append([len(pieces), 0])
        return ("".join(pieces[a:b]) for a, b in found)

    def first(self, tags: set[str]) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "table", "div", "article", "section", "main", "body", "li"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def _leave(self, n: Node) -> None:
        """Closes all nodes up to ``n``, and that."""
        k = self.at
        while k is not n.up:
            self.open[k.tag] -= 1
            k = k.up
        self.at = n.up

    def _close(self, tags, until):
        if not any(self.open.get(t) for t in tags):  # none to look for, however deep
            return
        n = self.at
        while n.up and n.tag not in until:
            if n.tag in tags:
                self._leave(n)
                return
            n = n.up

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        n = self.at
        while n.tag != tag:
            n = n.up
        self._leave(n)

    def handle_data(self, data):
        self.at.kids.append(data)


def _drop(node: Node) -> None:
    left = [node]
    while left:
        n = left.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not (k.tag in SKIP or {"ad", "sidebar"} & set(k.attrs.get("class", "").split()))]
        left += [k for k in n.kids if isinstance(k, Node)]


def squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def article_paragraphs(html: str | None, least: int = 10, budget: int = 12_000) -> list[str] | None:
    """Texts of p, h1-h6 and li in the first article (else main), in document order, up to the first that overflows; None without a container."""
    root = Tree(html or "").root
    _drop(root)
    top = root.first({"article"}) or next((n for n in root.walk() if n.tag == "main" or n.attrs.get("role") == "main"), None)
    if top is None:
        return None
    out, total = [], 0
    for text in top.texts(BLOCK):
        if len(t := squeeze(text)) >= least:
            if total + len(t) > budget:
                break
            total += len(t)
            out.append(t)
    return out


def listing_links(html: str | None, pattern: str = r"^/(news|engineering|research)/.+") -> list[dict]:
    """Links of a listing page: href, title of at least 10 characters, description and date; the first of each href."""
    out, seen = [], set()
    for a in Tree(html or "").root.walk():
        href = a.attrs.get("href", "")
        if a.tag != "a" or href in seen or not re.match(pattern, href):
            continue
        head = a.first({"h2", "h3", "h4"})
        title = squeeze((head or a).text())
        if len(title) < 10:
            continue
        seen.add(href)
        box = a.up
        while box and box.tag not in ("div", "article", "li"):
            box = box.up
        p, time = (box or a).first({"p"}), (box or a).first({"time"})
        out.append({"href": href, "title": title, "description": squeeze(p.text())[:500] if p else "", "date": time.attrs.get("datetime") if time else None})
    return out


def trending(html: str | None) -> list[dict]:
    """Repositories of a trending page."""
    out = []
    for box in Tree(html or "").root.walk():
        if box.tag != "article" or "Box-row" not in box.attrs.get("class", "").split():
            continue
        head = box.first({"h2"})
        link = head.first({"a"}) if head else None
        if link is None:
            continue
        name = link.attrs.get("href", "").strip("/")
        p = box.first({"p"})
        language = next((squeeze(n.text()) for n in box.walk() if n.attrs.get("itemprop") == "programmingLanguage"), "")
        stars = next((t for n in box.walk() if n.tag == "span" and "stars" in (t := squeeze(n.text())) and re.search(r"\d", t)), "")
        digits = re.search(r"\d+", stars.replace(",", ""))
        out.append({"full_name": name, "url": f"https://github.com/{name}", "description": squeeze(p.text()) if p else "", "language": language, "period_stars": int(digits[0]) if digits else 0})
    return out


STRING, STRINGS = T.StringType(), T.ArrayType(T.StringType())
BODY = T.StructType([T.StructField("paragraphs", STRINGS), T.StructField("reason", STRING)])
LINK = T.StructType([T.StructField(n, STRING) for n in ("href", "title", "description", "date")])
REPOSITORY = T.StructType([*(T.StructField(n, STRING) for n in ("full_name", "url", "description", "language")), T.StructField("period_stars", T.IntegerType())])


@F.pandas_udf(BODY)
def body(html: pd.Series) -> pd.DataFrame:
    """Paragraphs, and why there are none: missing_article or empty_article."""
    found = [article_paragraphs(h) for h in html]
    return pd.DataFrame({"paragraphs": [f or [] for f in found], "reason": ["missing_article" if f is None else None if f else "empty_article" for f in found]})


@F.pandas_udf(T.ArrayType(LINK))
def links(html: pd.Series) -> pd.Series:
    return html.map(listing_links)


@F.pandas_udf(T.ArrayType(REPOSITORY))
def repositories(html: pd.Series) -> pd.Series:
    return html.map(trending)
