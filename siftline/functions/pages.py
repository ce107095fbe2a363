"""Title, main text and links of crawled pages, by the standard library's HTML parser in an Arrow UDF."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = "struct<title: string, text: string, links: array<string>>"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style nav footer header".split())


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, _Node):
                stack.extend(reversed(node.children))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(reversed(attrs)), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, dict(reversed(attrs)), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _find(root: _Node, test):
    return next((n for n in root.walk() if isinstance(n, _Node) and test(n)), None)


def _strings(root: _Node) -> str:
    hidden = set()
    out = []
    for n in root.walk():
        if isinstance(n, _Node):
            if n is not root and n.tag in ("script", "style", "template"):
                hidden.update(id(c) for c in n.walk())
            continue
        if id(n) not in hidden and (s := n.strip()):
            out.append(s)
    return " ".join(out)


def parse(html: str, base: str) -> tuple[str, str, list[str]]:
    b = _Builder()
    b.feed(html or "")
    b.close()
    root = b.root
    title = _find(root, lambda n: n.tag == "title")
    title = title.children[0].strip() if title is not None and len(title.children) == 1 and isinstance(title.children[0], str) else ""
    tests = [lambda n: n.tag == "main", lambda n: n.tag == "article"]
    tests += [lambda n, i=i: n.attrs.get("id") == i for i in ("mw-content-text", "bodyContent", "content")]
    tests.append(lambda n: "content" in (n.attrs.get("class") or "").split())
    main = next((m for t in tests if (m := _find(root, t)) is not None), None)
    if main is not None:
        stack = [main]
        while stack:
            node = stack.pop()
            node.children = [c for c in node.children if isinstance(c, str) or c.tag not in _DROPPED]
            stack.extend(c for c in node.children if isinstance(c, _Node))
    text = _strings(main if main is not None else root)
    links = [urljoin(base or "", n.attrs["href"]) for n in root.walk() if isinstance(n, _Node) and n.tag == "a" and n.attrs.get("href") is not None]
    return title, text, links


def parsed(html: Column, url: Column) -> Column:
    """A struct of title, text and absolute links. Navigation, header and footer inside the main container go first, with
    the links they hold."""

    @F.pandas_udf(PAGE)
    def page(h, u):
        import pandas as pd

        return pd.DataFrame([parse(a, b) for a, b in zip(h, u)], columns=["title", "text", "links"], index=h.index)

    return page(html, url)
