"""Main text of web pages by a minimum cut.

A page becomes text blocks (what block-level tags set apart).  Each block has two capacities: what its text says for
content (length, full sentences, standing in an article) and for boilerplate (links, short labels, standing in a
menu, footer, notice, advert, form or comments).  Smoothness edges join blocks that follow each other, the heavier
the closer they stand in the page's tree.  The cut of least cost between source (content) and sink (boilerplate)
labels the blocks: one odd block among its like follows them.

Blocks whose own capacity outweighs all their open edges have that label in every least cut, so they are fixed
first and their edges become capacity of their neighbours; max-flow runs on what stays open.

Nulls and odd rows: no html and html without content give the empty text.  Unclosed and crossed tags end where a
browser would end them; an unclosed script or style runs to the end of the page.  Every row gives one row.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.llm.tables import computed

OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
LOOSE = r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
TAG = re.compile(rf"{OTHER}|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|{LOOSE}", re.S)
#: For what follows a quote that never closes.
LOOSE_TAG = re.compile(f"{OTHER}|{LOOSE}", re.S)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "title", "textarea", "object", "canvas", "video", "audio", "select"}
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rb", "rt", "rp",
}
#: Tags that end an open one of the same row.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSED_IN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

MAIN_TAGS = {"article", "main"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label", "head"}
MAIN_WORDS = {"article", "content", "entry", "main", "post", "story", "text", "body", "prose"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "aside", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "dialog", "discussion", "disqus", "footer", "form", "gdpr", "header",
    "legal", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "outbrain",
    "overlay", "pager", "pagination", "popup", "promo", "promoted", "rail", "recommended", "related", "replies", "reply", "respond", "search",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "topbar", "trending",
    "widget", "widgets", "complementary", "contentinfo", "alert",
}
NOT_A_PLACE = {"has", "no", "with", "without", "is", "hide", "show"}

#: Tree steps between two blocks that follow each other, and the weight of their edge.
NEAR = {0: 2.0, 1: 2.0, 2: 1.5, 3: 0.75, 4: 0.75}
FAR = 0.25


class Node:
    """An open or closed element: its place in the tree and what its marks say about its text."""

    __slots__ = ("tag", "parent", "depth", "main", "junk")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.main = bool(parent and parent.main) or tag in MAIN_TAGS
        self.junk = parent.junk if parent else ""
        if tag in MAIN_TAGS:
            self.junk = "" if self.junk == "form" else self.junk
        elif tag in BOILERPLATE_TAGS or tag == "header" and not self.main:
            self.junk = self.junk or tag
        if attributes and tag not in ("html", "body"):
            for kind, *values in MARK.findall(attributes):
                self.read(kind.lower(), "".join(values))
            if HIDDEN.search(attributes):
                self.junk = self.junk or "hidden"

    def read(self, kind: str, value: str) -> None:
        """The last telling word of each name decides: `main-menu` is a menu, `menu-text` a text."""
        for name in value.split():
            words = [w.lower() for w in WORD.findall(name)]
            if words and words[0] in NOT_A_PLACE:
                continue
            told = [w for w in words if w in MAIN_WORDS or w in BOILERPLATE_WORDS]
            if not told:
                continue
            if told[-1] in MAIN_WORDS:
                self.main = self.main or not self.junk
            elif self.tag not in MAIN_TAGS and not (told[-1] == "header" and self.main):
                self.junk = self.junk or told[-1]


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order, character references decoded, white space turned into single spaces."""
    root = Node("", None)
    stack, opened = [root], Counter()
    parts: list[str] = []
    links: list[str] = []
    out: list[Block] = []
    at, in_link, search = 0, 0, TAG.search

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                block = next(n for n in reversed(stack) if n.tag not in INLINE)
                out.append(Block(text, block, len(" ".join(unescape("".join(links)).split()))))
            parts.clear()
            links.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            links.append(text)

    def pop_to(k: int) -> None:
        nonlocal in_link
        for node in stack[k:]:
            opened[node.tag] -= 1
            in_link -= node.tag == "a"
        del stack[k:]

    def find(tags: set[str], stop: set[str]) -> int:
        """Place of the nearest open one of `tags`, not looking beyond one of `stop`; 0 without."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stop:
                return 0
        return 0

    while at < len(html):
        found = search(html, at) if html.find(">", at) >= 0 or html.find("<!", at) >= 0 else None
        if not found:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        closing, tag, attributes, *loose = found.groups()
        if not tag:
            if not loose or not loose[1]:
                continue
            (closing, tag, attributes), search = loose, LOOSE_TAG.search
        tag = tag.lower()
        if closing:
            if tag in INLINE:
                k = len(stack) - 1
                while k and stack[k].tag in INLINE and stack[k].tag != tag:
                    k -= 1
                if k and stack[k].tag == tag:
                    pop_to(k)
                continue
            flush()
            if opened[tag] > 0:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = len(html) if not end else html.find(">", end.start()) + 1 or len(html)
            if tag not in INLINE:
                add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                add(" ")
            continue
        if tag not in INLINE:
            flush()
            if opened["p"] > 0:
                k = find({"p"}, {"td", "th", "button", "object", "li", "div", "section", "article"})
                if k:
                    pop_to(k)
            if tag in ENDED_BY and (k := find(ENDED_BY[tag], CLOSED_IN[tag])):
                pop_to(k)
        if attributes.endswith("/") and tag not in INLINE:
            continue
        stack.append(Node(tag, stack[-1], attributes))
        opened[tag] += 1
        in_link += tag == "a"
    flush()
    return out


def steps(a: Node, b: Node) -> int:
    """Tree edges between two elements; many count as 9."""
    n = 0
    while a is not b and n < 9:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def capacity(block: Block, has_main: bool) -> float:
    """Evidence for content less evidence for boilerplate."""
    size = len(block.text)
    linked = min(1.0, block.linked / size)
    content = min(size, 400) / 100 * (1 - linked) + (block.text[-1] in ".!?…\"”»")
    junk = 4 * linked + (size < 25 and block.text[-1] not in ".!?…")
    if block.node.junk:
        junk += 24
    elif block.node.main:
        content += 6
    elif has_main:
        junk += 5
    return content - junk


def least_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content or not for each node: terminal is the source capacity (negative: the sink's), edges have weights."""
    n = len(terminal)
    excess = list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and abs(excess[i]) >= sum(near[i].values()):
            label[i] = excess[i] > 0
            for j, w in near[i].items():
                excess[j] += w if label[i] else -w
                del near[j][i]
                waiting.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        reached = _reached(left, excess, near)
        for i in left:
            label[i] = i in reached
    return [bool(x) for x in label]


def _reached(nodes: list[int], excess: list[float], near: list[dict[int, float]]) -> set[int]:
    """Max-flow by shortest augmenting paths; what the source still reaches is its side of the cut."""
    rest: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    rest[-1], rest[-2] = {}, {}
    for i in nodes:
        rest[-1][i], rest[i][-1] = max(excess[i], 0.0), 0.0
        rest[i][-2], rest[-2][i] = max(-excess[i], 0.0), 0.0
    while True:
        came = {-1: -1}
        queue = deque([-1])
        while queue and -2 not in came:
            i = queue.popleft()
            for j, room in rest[i].items():
                if room > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if -2 not in came:
            return set(came)
        path = [-2]
        while path[-1] != -1:
            path.append(came[path[-1]])
        steps_ = list(zip(path[1:], path[:-1], strict=True))
        flow = min(rest[i][j] for i, j in steps_)
        for i, j in steps_:
            rest[i][j] -= flow
            rest[j][i] += flow


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by spaces."""
    blocks = blocks_of(html) if html else []
    has_main = any(b.node.main and not b.node.junk for b in blocks)
    edges = [(i, i + 1, NEAR.get(steps(a.node, b.node), FAR)) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False))]
    # blocks of one parent that something stands between
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        k = last.get(id(b.node.parent), i)
        if k < i - 1:
            edges.append((k, i, 1.0))
        last[id(b.node.parent)] = i
    content = least_cut([capacity(b, has_main) for b in blocks], edges)
    return " ".join(b.text for b, yes in zip(blocks, content, strict=True) if yes)


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def make():
        def step(values: list) -> dict:
            texts = [main_text(v) for v in values]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return step

    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    return computed(rows, "_html", "text string, n_chars long", make)
