"""Main content of a page, by four layers that end at the first hit. Per-document, pure Python.

0. elements that match a blacklist go; 1. main, article or role=main; 2. containers known from documentation
frameworks; 3. chrome is cleared away and the densest container wins. Equal scores are decided by document order.

Counts of all subtrees are added up once, from the leaves, so a page costs time in proportion to its size.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

from .dom import ELEMENT, HEADINGS, TEXT, Node, find, find_all, parse, prune

NO_CONTENT, NOT_HTML = "no content", "not an HTML content"

CONTAINERS = (
    ".content", ".doc-content", ".markdown-body", "#docs-content", ".rst-content", ".theme-doc-markdown", ".md-content",
    "#content-area", ".mdx-content", ".docMainContainer", ".document", ".md-main__inner", ".book-body", ".markdown-section",
    ".theme-default-content", ".content__default", "#main", ".post-content", ".article-content", ".entry-content",
)
SEMANTIC = ("main", "article", "[role='main']")
CHROME_TAGS = frozenset(("nav", "footer", "aside"))
CHROME_WORDS = ("nav", "sidebar", "menu", "breadcrumb", "search", "footer", "header", "cookie", "consent", "version", "language", "theme", "edit", "github")


@dataclass(frozen=True)
class ExtractParams:
    body_bias: float = 0.75
    near_best: float = 0.9
    link_density: float = 0.8
    per_text: float = 50.0
    per_paragraph: float = 5.0
    per_heading: float = 10.0
    per_code: float = 15.0
    per_item: float = 2.0
    min_text: int = 50
    min_headings: int = 0
    min_blocks: int = 1
    max_link_density: float = 0.8
    selectors: tuple[str, ...] = field(default=())
    blacklist: tuple[str, ...] = field(default=())


@dataclass
class Counts:
    text_bytes: int = 0
    solid: int = 0  # characters that aren't space
    paragraphs: int = 0
    headings: int = 0
    top_headings: int = 0
    code_blocks: int = 0  # pre > code counts once
    code_any: int = 0  # pre > code counts twice
    items: int = 0
    links: int = 0
    link_bytes: int = 0


def _add(out: Counts, n: Node) -> None:
    """What a node itself adds to the counts of all that hold it."""
    if n.kind == TEXT:
        out.text_bytes += len(n.name.encode())
        out.solid += len("".join(n.name.split()))
    elif n.kind == ELEMENT:
        name = n.name
        if name == "p":
            out.paragraphs += 1
        elif name in HEADINGS:
            out.headings += 1
            out.top_headings += name <= "h3"
        elif name == "pre":
            holds = any(c.kind == ELEMENT and c.name == "code" for c in n.children)
            out.code_blocks += holds
            out.code_any += holds
        elif name == "code":
            out.code_blocks += n.parent is None or n.parent.name != "pre"
            out.code_any += 1
        elif name == "li":
            out.items += 1
        elif name == "a":
            out.links += 1
            out.link_bytes += sum(len(c.name.strip().encode()) for c in n.children if c.kind == TEXT)


def count(node: Node) -> Counts:
    out = Counts()
    for n in node.walk():
        _add(out, n)
    return out


_COUNTED = tuple(Counts.__dataclass_fields__)
_COUNTED_NAMES = frozenset((*HEADINGS, "p", "pre", "code", "li", "a"))


def meaningful(node: Node, p: ExtractParams) -> bool:
    c = count(node)
    if c.solid < p.min_text:
        return False
    if c.text_bytes and c.link_bytes / c.text_bytes > p.max_link_density and c.links > 2:
        return False
    return c.paragraphs >= p.min_blocks or c.code_any >= p.min_blocks or (c.headings > p.min_headings and c.solid >= 20)


def score(c: Counts, p: ExtractParams) -> float:
    value = c.solid / p.per_text + c.paragraphs * p.per_paragraph + c.top_headings * p.per_heading + c.code_blocks * p.per_code + c.items * p.per_item
    density = c.link_bytes / c.text_bytes if c.text_bytes else 0.0
    return value - (density - p.link_density) * value if density > p.link_density else value


class Places:
    """Where each element of a document begins and ends in document order, where its h1 stand and where its content headers.

    A content header is one that has an h1, or over 50 bytes of text outside navigation and lists.
    """

    def __init__(self, root: Node) -> None:
        nodes = self.nodes = list(root.walk())
        self.begin = {id(n): k for k, n in enumerate(nodes)}
        self.end: dict[int, int] = {}
        prose: dict[int, int] = {}
        titled: dict[int, bool] = {}
        for n in reversed(nodes):
            key = id(n)
            self.end[key] = self.end[id(n.children[-1])] if n.children else self.begin[key] + 1
            titled[key] = n.name == "h1" or any(titled[id(c)] for c in n.children)
            prose[key] = len(n.name.strip().encode()) if n.kind == TEXT else sum(prose[id(c)] for c in n.children if c.kind == TEXT or c.name not in ("nav", "ul", "ol"))
        self.h1 = [k for k, n in enumerate(nodes) if n.kind == ELEMENT and n.name == "h1"]
        self.headers = [n for n in nodes if n.kind == ELEMENT and n.name == "header" and (titled[id(n)] or prose[id(n)] > 50)]
        self.header_at = [self.begin[id(n)] for n in self.headers]

    def counts(self, some: list[Node]) -> list[Counts]:
        """The counts of the subtrees of some nodes, as differences of running sums."""
        own = np.zeros((len(self.nodes) + 1, len(_COUNTED)), np.int64)
        for k, n in enumerate(self.nodes, 1):
            if n.kind == TEXT or n.name in _COUNTED_NAMES:
                c = Counts()
                _add(c, n)
                own[k] = [getattr(c, key) for key in _COUNTED]
        sums = own.cumsum(axis=0)
        return [Counts(*(sums[self.end[id(n)]] - sums[self.begin[id(n)]]).tolist()) for n in some]

    def _within(self, places: list[int], n: Node) -> int:
        return bisect_left(places, self.end[id(n)]) - bisect_left(places, self.begin[id(n)])

    def loses_header(self, candidate: Node) -> bool:
        """Whether taking ``candidate`` would leave a content header outside, having no h1 of its own."""
        return not self._within(self.h1, candidate) and self._within(self.header_at, candidate) < len(self.headers)


def without_chrome(document: Node) -> Node:
    root = document.clone()
    kept = {id(h) for h in Places(root).headers}
    prune([n for n in root.elements() if n.name in CHROME_TAGS or (n.name == "header" and id(n) not in kept)])
    headers, inside = {id(h) for h in Places(root).headers}, set()
    gone = []
    for n in root.elements():  # parents come before their children
        if id(n) in headers or id(n.parent) in inside:
            inside.add(id(n))
        elif n.attrs:
            words = " ".join(v for k, v in n.attrs if k in ("class", "id")).lower()
            if any(w in words for w in CHROME_WORDS):
                gone.append(n)
    prune(gone)
    return root


def densest(document: Node, p: ExtractParams) -> Node | None:
    places = Places(document)
    some = [n for n in places.nodes if n.kind == ELEMENT and n.name in ("div", "section", "body")]
    candidates = [(n, score(c, p)) for n, c in zip(some, places.counts(some), strict=True)]
    best, top = None, 0.0
    for n, s in candidates:
        if s > top:
            best, top = n, s
    if best is None:
        return None
    body = next((n for n, _ in candidates if n.name == "body"), None)
    if best is body:
        whole = top
        for n, s in candidates:
            if n is not body and s >= p.body_bias * whole and s > p.near_best * top and not places.loses_header(n):
                return n
    elif body is not None and places.loses_header(best):
        return body
    return best


@dataclass
class Extracted:
    node: Node | None
    layer: int | None = None
    selector: str | None = None
    cause: str | None = None


def is_html(document: Node) -> bool:
    """Whether there is an html element. The parser makes one for any text, so this fails for trees of other origin only."""
    return any(n.name == "html" for n in document.elements())


def extract(source: str, p: ExtractParams = ExtractParams()) -> Extracted:
    return extract_tree(parse(source), p)


def extract_tree(document: Node, p: ExtractParams = ExtractParams()) -> Extracted:
    if not is_html(document):
        return Extracted(None, cause=NOT_HTML)
    for s in p.blacklist:
        prune(find_all(document, s))
    for s in SEMANTIC:
        n = find(document, s)
        if n is not None and meaningful(n, p):
            return Extracted(n, 1, s)
    places = None
    for s in dict.fromkeys((*CONTAINERS, *p.selectors)):
        n = find(document, s)
        if n is not None and meaningful(n, p):
            places = places or Places(document)
            if not places.loses_header(n):
                return Extracted(n, 2, s)
    n = densest(without_chrome(document), p)
    if n is not None and meaningful(n, p):
        return Extracted(n, 3, n.name)
    return Extracted(None, cause=NO_CONTENT)
