"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text. A linear classifier (tag and class hints of the enclosing elements, link density,
length, punctuation and more) gives each block the log odds of being content; these are the capacities to the two
terminals. Blocks that follow one another, and blocks with the same parent, are joined by smoothness edges, the heavier
the more of the DOM path they share. The minimum cut, found by max-flow, is the cheapest labelling.

The classifier's weights are fitted by logistic regression to blocks of a sample of pages whose markup labels them (inside
an article or main element, or not), each block once with its markup and once as if the markup said nothing. A prior keeps
them near PRIOR where the sample says little.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import pieces, schema_of, table, text_of

_HINT = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|\d+")

BLOCK = frozenset("address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html input legend li link main menu menuitem meta nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio canvas embed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of these, if no element of the second set is between.
CLOSES = {t: (frozenset([t]), frozenset(["ul", "ol", "menu", "dl", "table"])) for t in ("li", "option")} | {t: (frozenset(["dt", "dd"]), frozenset(["dl"])) for t in ("dt", "dd")} | {t: (frozenset(["td", "th"]), frozenset(["table"])) for t in ("td", "th")} | {"tr": (frozenset(["tr"]), frozenset(["table"]))}
#: Elements that never hold the article's text, and words of class, id or role that say so.
AWAY = frozenset("nav footer aside form head button select menu dialog fieldset input".split())
AWAY_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner sidebar sidebars rail menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot colophon copyright masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox form widget widgets pagination pager toolbar complementary contentinfo".split()
)
HEADS = frozenset(["header"])
HEAD_HINTS = frozenset(["header", "heading"])
HOME = frozenset(["article", "main"])
HOME_HINTS = frozenset("article main content post entry story body text maincontent articlebody".split())

#: Features of a block and their weights before anything is learned, in twentieths of the log odds.
PRIOR = {
    "one": -10.0, "home": 120.0, "home_hint": 40.0, "head": -60.0, "away": -400.0, "link_share": -60.0, "length": 40.0, "sentence": 15.0, "short": -15.0,
    "in_list": 0.0, "heading": 0.0, "paragraph": 0.0, "marks": 0.0, "digits": 0.0, "depth": 0.0,
}
#: Those that the markup's meaning gives.
MARKUP = ("home", "home_hint", "head", "away")
#: Weights of the smoothness edges.
NEXT, SIBLING = 8, 6
#: Pages that the weights are fitted to (about; four times as many at most), and blocks of each of them.
SAMPLE, SAMPLE_BLOCKS = 1000, 64
#: Elements whose content isn't text of the page.
RAW = frozenset("script style noscript template svg iframe textarea title object".split())
_RAW_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
#: Tags whose quotes never close on a page, until quotes are no longer looked at.
PATIENCE = 8


def tags(html: str):
    """(kind, name, text) of a page's pieces in turn: "text", "open" with attributes, "close", and "raw" for an element whose
    content is passed over. Time is linear in the page, whatever is left open."""
    at, n, last, patience = 0, len(html), html.rfind(">"), PATIENCE
    while at < n:
        k = html.find("<", at)
        if k < 0 or k > last:  # no tag can end any more
            rest = html[at:] if k < 0 or not html.startswith("<!--", k) else html[at:k]
            if rest:
                yield "text", "", rest
            return
        if k > at:
            yield "text", "", html[at:k]
        if html.startswith("<!--", k):
            end = html.find("-->", k + 4)
            if end < 0:
                return
            at = end + 3
            continue
        close = html.startswith("</", k)
        name = _NAME.match(html, k + 1 + close)
        if not name:
            if close or html.startswith(("<!", "<?"), k):
                at = html.find(">", k) + 1
            else:
                yield "text", "", "<"
                at = k + 1
            continue
        tag, end = name[0].lower(), name.end()
        stop = None
        if patience:
            here = end
            while (m := _STOP.search(html, here)) and m[0] != ">":
                here = html.find(m[0], m.end()) + 1
                if not here:
                    m = None
                    break
            stop = m.start() if m else None
            patience -= stop is None
        if stop is None:
            stop = html.find(">", end)
        attributes, at = html[end:stop], stop + 1
        if close:
            yield "close", tag, ""
        elif tag in RAW:
            if not attributes.endswith("/"):
                m = _RAW_ENDS[tag].search(html, at)
                at = m.end() if m else n
            yield "raw", tag, ""
        else:
            yield "open", tag, attributes


class _Open:
    __slots__ = ("tag", "away", "home", "hint", "head", "link", "node", "depth", "block")

    def __init__(self, tag, away, home, hint, head, link, node, depth, block):
        self.tag, self.away, self.home, self.hint, self.head, self.link, self.node, self.depth = tag, away, home, hint, head, link, node, depth
        self.block = block or self  # the innermost element that makes a block of its text


_ROOT = _Open("", False, False, False, False, False, 0, 0, None)


def _hints(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    out: set[str] = set()
    for m in _HINT.finditer(attributes):
        out.update(_PART.findall((m[1] or m[2] or m[3] or "").lower()))
    return out


def blocks(html: str) -> list[tuple[str, int, _Open]]:
    """Text, characters inside links and innermost block element of each block that has text, in page order."""
    stack, out, nodes = [_ROOT], [], 0
    parts: list[str] = []
    linked = 0
    counts: Counter = Counter()  # open elements by tag, so that a stray tag costs nothing

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, linked, stack[-1].block))
            parts.clear()
        linked = 0

    def shut(k):
        for e in stack[k:]:
            counts[e.tag] -= 1
        del stack[k:]

    for kind, tag, text in tags(html):
        if kind == "text":
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())
            continue
        if kind == "raw":
            if tag == "title":
                flush()
            continue
        block = tag in BLOCK
        if kind == "close":
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if counts[tag] > 0 else 0
            if block or k and stack[k].away and not stack[k - 1].away:
                flush()
            if k:
                shut(k)
            continue
        hints = _hints(text)
        if block:
            flush()
        if block and tag != "br":
            above = stack[-1].block
            if counts["p"] > 0 and above.tag == "p":  # a block ends an open paragraph
                shut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k] is above))
            if tag in CLOSES and any(counts[t] > 0 for t in CLOSES[tag][0]):
                ends, stops = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        shut(k)
                        break
                    if stack[k].tag in stops:
                        break
        if tag in VOID:
            continue
        up = stack[-1]
        page = tag in ("html", "body")  # their classes speak of the page
        away = tag in AWAY or bool(hints & AWAY_HINTS) and not page and tag not in HOME
        if away and not block and not up.away:
            flush()
        head = tag in HEADS or bool(hints & HEAD_HINTS) and not page
        nodes += 1
        if not text.endswith("/") or block:
            away = up.away or away or tag in HOME and bool(hints & {"comment", "comments", "reply", "ad", "advert", "sponsored", "related"})
            own = None if block or away else up.block
            stack.append(_Open(tag, away, up.home or tag in HOME or "main" in hints and not page, up.hint or bool(hints & HOME_HINTS) and not page, up.head or head and not up.home, up.link or tag == "a", nodes, up.depth + 1, own))
            counts[tag] += 1
    flush()
    return out


def features(text: str, linked: int, at: _Open) -> list[float]:
    """Those of PRIOR, in its order."""
    share = min(1.0, linked / len(text))
    size = max(1, len(text))
    return [
        1.0, at.home, at.hint, at.head, at.away, share, min(1.0, len(text) / 400) * (share < 0.5), text[-1] in ".!?…:;”\"'。！？", len(text) < 25,
        at.tag in ("li", "td", "th", "dd", "dt", "option"), at.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), at.tag in ("p", "blockquote", "pre"),
        min(1.0, 20 * sum(map(text.count, ",.;")) / size), sum(map(str.isdigit, text)) / size, min(1.0, at.depth / 20),
    ]


def fitted(x: np.ndarray, content: np.ndarray, prior: np.ndarray, strength: float = 0.02, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression with a Gaussian prior around prior, by Newton's method on averages."""
    w, scale = prior.copy(), 20.0
    if not len(x) or content.min() == content.max():
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w / scale, -30, 30)))
        slope = x.T @ (content - p) / len(x) - strength * (w - prior) / scale
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + strength * np.eye(len(w))
        w = w + scale * np.linalg.solve(curve, slope)
    return w


def _labelled(batches):
    """Features of some blocks of pages whose markup has a home for the article, and whether they are in it: with the markup, and
    with the markup's features at 0."""
    blank = [k for k, f in enumerate(PRIOR) if f in MARKUP]
    for batch in pieces(batches, "html"):
        rows, labels = [], []
        for html in batch.column(batch.schema.get_field_index("html")).to_pylist():
            found = blocks(html)
            if not any(at.home for _, _, at in found):
                continue
            for text, linked, at in sorted(found, key=lambda b: zlib.crc32(b[0].encode()))[:SAMPLE_BLOCKS]:
                x = list(map(float, features(text, linked, at)))
                rows += [x, [0.0 if k in blank else v for k, v in enumerate(x)]]
                labels += [at.home and not at.away] * 2
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.bool_())], ["x", "content"])


def learned(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted to about sample pages, those of the smallest hashes: at most four times as many, and SAMPLE_BLOCKS blocks of
    each, so that the driver's share is bounded."""
    n = pages.count()
    prior = np.array(list(PRIOR.values()))
    if not n:
        return prior
    share = min(1.0, sample / n)
    x = pages.select(text_of("html").alias("html")).where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < max(1, round(share * 1_000_000))).limit(4 * sample)
    rows = sorted(map(tuple, x.mapInArrow(_labelled, "x array<double>, content boolean").collect()))
    return fitted(np.array([r[0] for r in rows]).reshape(-1, len(prior)), np.array([r[1] for r in rows], float), prior)


def minimum_cut(content: list[int], boiler: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the content side of the minimum cut. Dinic's max-flow; ties go to boilerplate."""
    n = len(content)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def join(a, b, forth, back):
        graph[a].append(len(to))
        to.append(b)
        cap.append(forth)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        if (d := content[i] - boiler[i]) > 0:
            join(s, i, d, 0)
        elif d < 0:
            join(i, t, -d, 0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(k for k, e in enumerate(path) if not cap[e])
                x = to[path[k] ^ 1]
                del path[k:]
            while at[x] < len(graph[x]):
                e = graph[x][at[x]]
                if cap[e] and level[to[e]] == level[x] + 1:
                    break
                at[x] += 1
            else:
                if x == s:
                    break
                level[x] = -1
                x = to[path.pop() ^ 1]
                continue
            path.append(e)
            x = to[e]


def main_text(html: str, weights: np.ndarray | None = None) -> str:
    """The blocks that the cut labels as content, joined by one space; empty if there are none."""
    found = blocks(html)
    if not found:
        return ""
    odds = np.rint(np.array([features(*x) for x in found], float) @ (np.array(list(PRIOR.values())) if weights is None else weights)).astype(int).tolist()
    edges, last = [], {}
    for k, (_, _, at) in enumerate(found):
        if k:
            before = found[k - 1][2]
            edges.append((k - 1, k, NEXT * 2 if before.node == at.node else NEXT if abs(before.depth - at.depth) < 2 else NEXT // 2))
        if at.node in last and last[at.node] != k - 1:
            edges.append((last[at.node], k, SIBLING))
        last[at.node] = k
    keep = minimum_cut([max(0, z) for z in odds], [max(0, -z) for z in odds], edges)
    return " ".join(x[0] for x, k in zip(found, keep) if k)


def _extract(weights: np.ndarray, html: int, columns: int, names: list[str]):
    def run(batches):
        for batch in pieces(batches, names[html]):
            texts = [main_text(h or "", weights) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(texts, pa.string())], [*names[:columns], names[-1]])

    return run


def with_main_text(pages: DataFrame, columns: list[str], out: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """columns of pages (not html) and the main text of each row's html, as out; a column of that name among columns is
    replaced. weights: those of learned(), else PRIOR.

    A null or empty html, and a page of boilerplate only, give an empty text. Malformed and very long pages take time in
    proportion to their length. Repeated rows stay, other columns may have any names, an empty table gives no rows. Each
    page is a matter of its own: nothing is shuffled.
    """
    columns = [c for c in columns if c.lower() != out.lower()]
    names = [f"c{k}" for k in range(len(columns))] + ["html", "main"]
    x = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)), text_of("html").alias("html"))
    got = x.mapInArrow(_extract(weights, len(columns), len(columns), names), schema_of(x.schema.fields[:-1], "main string"))
    return got.select(*(F.col(n).alias(c) for n, c in zip(names, columns)), F.col("main").alias(out))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by weights fitted to a sample of them."""
    pages = table(spark, sf_dir, "pages")
    return with_main_text(pages, ["page_id", "url"], weights=learned(pages)).withColumn("n_chars", F.char_length("text").cast("long"))
