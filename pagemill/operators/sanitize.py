"""Structural repair of a page's main content. Per-document, pure Python; the tree is changed in place.

First the content must be repairable: one root, an anchor, no two h1 side by side. Then tabs are laid out one
after the other, heading levels closed up, and eyebrows, hidden, empty and repeated elements removed; links are
read from what is left.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from .dom import COMMENT, ELEMENT, HEADINGS, TEXT, VOID, Node, find_all, prune

UNPARSEABLE = "unparseable html"
COMPETING_ROOTS, NO_ANCHOR, MANY_H1 = "competing document roots", "no structural anchor", "multiple h1 without primary root"
MANY_DOCUMENTS, AMBIGUOUS = "implied multiple documents", "ambiguous dom structure"
KEEP_EMPTY = VOID | {"html", "head", "body", "main"}
NEVER_REPEATED = frozenset((*HEADINGS, "main", "article", "header", "footer", "nav", "aside"))


@dataclass
class Sanitized:
    node: Node | None
    links: list[str] = field(default_factory=list)
    cause: str | None = None


def level(n: Node) -> int:
    return int(n.name[1]) if n.kind == ELEMENT and n.name in HEADINGS else 0


def repairable(root: Node) -> str | None:
    """Why the content can't be repaired, or None; the first reason in this order counts."""
    below = [n for n in root.elements() if n is not root]
    if sum(n.name == "main" for n in below) > 1:
        return COMPETING_ROOTS
    parents = [id(n.parent) for n in below if n.name == "article"]
    if len(parents) > len(set(parents)):
        return COMPETING_ROOTS
    if not any(level(n) or n.name in ("article", "main", "section") for n in below):
        return NO_ANCHOR
    parents = [id(n.parent) for n in below if n.name == "h1"]
    if len(parents) > len(set(parents)):
        return MANY_H1
    if implied_documents(below):
        return MANY_DOCUMENTS
    if _deep_sections(root) > 2:
        return AMBIGUOUS
    return None


def heading_list(below: list[Node]) -> list[Node]:
    """Headings by level and then in document order: the order that the section tests below go by."""
    return sorted((n for n in below if level(n)), key=level)


def implied_documents(below: list[Node]) -> bool:
    """Several h1, of which two or more have two deeper headings each before the next h1 in ``heading_list``.

    In that order all h1 come first, so only the last can have any, and this never holds for a real tree.
    """
    levels = [level(n) for n in heading_list(below)]
    tops = [k for k, x in enumerate(levels) if x == 1]
    return sum(b - a > 2 for a, b in zip(tops, [*tops[1:], len(levels)], strict=False)) > 1


def _deep_sections(root: Node) -> int:
    """How many articles and sections below the root have more than three of them above."""
    above = sum(a.name in ("article", "section") for a in root.ancestors())
    found, todo = 0, [(root, above)]
    while todo:
        n, above = todo.pop()
        mine = n.kind == ELEMENT and n.name in ("article", "section")
        found += mine and above > 3 and n is not root
        todo.extend((c, above + mine) for c in n.children)
    return found


class _Headings:
    """Headings of a tree by their place in document order, while tab labels come in and tab bars go."""

    def __init__(self, root: Node) -> None:
        self.nodes = list(root.walk())
        self.begin = {id(n): float(k) for k, n in enumerate(self.nodes)}
        self.end: dict[int, float] = {}
        for n in reversed(self.nodes):
            self.end[id(n)] = self.end[id(n.children[-1])] if n.children else self.begin[id(n)] + 1
        self.places = [self.begin[id(n)] for n in self.nodes if level(n)]
        self.found = [n for n in self.nodes if level(n)]
        self.outer = 1  # level of the last heading before the root in the whole document
        for n in [root, *root.ancestors()][-1].walk():
            if n is root:
                break
            self.outer = level(n) or self.outer

    def before(self, n: Node) -> int:
        """Level of the nearest heading before ``n``; 1 if there is none."""
        k = bisect_left(self.places, self.begin[id(n)])
        return level(self.found[k - 1]) if k else self.outer

    def _stop(self, n: Node) -> int:
        # a label that stands right after the last node is half a place beyond it
        return bisect_right(self.places, self.end[id(n)] - 0.75)

    def inside(self, n: Node) -> list[Node]:
        return self.found[bisect_right(self.places, self.begin[id(n)]) : self._stop(n)]

    def insert(self, heading: Node, before: Node) -> None:
        # half a place before the panel, and after labels that came there earlier
        at = self.begin[id(before)] - 0.5
        k = bisect_right(self.places, at)
        self.places.insert(k, at)
        self.found.insert(k, heading)

    def drop(self, n: Node) -> None:
        i, j = bisect_left(self.places, self.begin[id(n)]), self._stop(n)
        del self.places[i:j], self.found[i:j]


def linearize_tabs(root: Node) -> None:
    """Every tab panel gets its tab's label as a heading, its own headings move below that, and the tab bar goes."""
    bars = find_all(root, "[role='tablist']")
    if not bars:
        return
    known = _Headings(root)
    by_id: dict[str, list[Node]] = {}
    for n in known.nodes:
        if n.kind == ELEMENT and n is not root and (name := n.get("id")):
            by_id.setdefault(name, []).append(n)
    child_at: dict[int, dict[int, int]] = {}  # of a parent its children's places
    heads: dict[int, tuple[list[float], dict[float, Node]]] = {}  # of a parent the places of headings among its children
    labels: dict[int, list[Node]] = {}  # of a panel the headings that go before it
    gone: list[Node] = []
    gone_begin: list[float] = []

    def removed(n: Node) -> bool:
        k = bisect_right(gone_begin, known.begin[id(n)])
        return bool(k) and known.begin[id(n)] < known.end[id(gone[k - 1])]

    def siblings(parent: Node) -> tuple[dict[int, int], tuple[list[float], dict[float, Node]]]:
        if id(parent) not in child_at:
            child_at[id(parent)] = {id(c): k for k, c in enumerate(parent.children)}
            there = {float(k): c for k, c in enumerate(parent.children) if level(c)}
            heads[id(parent)] = (sorted(there), there)
        return child_at[id(parent)], heads[id(parent)]

    for bar in bars:
        if removed(bar):
            continue
        panels: list[Node] | None = None
        for k, tab in enumerate(find_all(bar, "[role='tab']")):
            wanted = tab.get("aria-controls")
            panel = next((n for n in by_id.get(wanted, ()) if not removed(n)), None) if wanted else None
            if panel is None:
                if panels is None:
                    panels = [n for n in find_all(bar.parent, "[role='tabpanel']") if id(n) in known.begin and not removed(n)] if bar.parent is not None else []
                panel = panels[k] if k < len(panels) else None
            if panel is None or panel.parent is None or panel is root:
                continue
            places, (order, there) = siblings(panel.parent)
            at = places[id(panel)] - 0.5
            label = tab.text().strip()
            depth = min(known.before(bar) + 1, 6)
            if label:
                heading = Node(ELEMENT, f"h{depth}")
                heading.append(Node(TEXT, label))
                heading.parent = panel.parent
                labels.setdefault(id(panel), []).append(heading)
                known.insert(heading, panel)
                if at not in there:
                    insort(order, at)
                there[at] = heading
            else:
                i = bisect_right(order, at)
                depth = level(there[order[i - 1]]) if i else 0
            inner = known.inside(panel)
            top = min(map(level, inner), default=7)
            if top <= depth:
                for n in inner:
                    n.name = f"h{min(6, max(1, level(n) + depth + 1 - top))}"
        known.drop(bar)
        gone.append(bar)
        gone_begin.append(known.begin[id(bar)])
    for parent in {id(n.parent): n.parent for n in known.nodes if id(n) in labels}.values():
        parent.children = [x for c in parent.children for x in (*labels.get(id(c), ()), c)]
    prune(gone)


def renumber_headings(root: Node) -> None:
    """No heading is more than one level below the heading before it."""
    before = 0
    for n in root.elements():
        if level(n):
            if level(n) > before + 1:
                n.name = f"h{before + 1}"
            before = level(n)


def _remove_all(root: Node, unwanted: Callable[[Node], bool]) -> None:
    prune([n for n in root.elements() if n is not root and unwanted(n)])


def remove_eyebrows(root: Node) -> None:
    """Where there is an h1, elements marked as eyebrows go, whether they stand before it or not."""
    if any(n.name == "h1" for n in root.elements()):
        _remove_all(root, lambda n: any("eyebrow" in v.lower() for k, v in n.attrs if k in ("class", "id")))


def remove_hidden(root: Node) -> None:
    _remove_all(root, lambda n: n.get("aria-hidden") == "true")


def remove_empty(root: Node) -> None:
    """From the leaves up: elements with neither elements nor text that isn't blank."""
    gone: set[int] = set()
    nodes = list(root.elements())
    for n in reversed(nodes):
        if n is root or n.name in KEEP_EMPTY:
            continue
        if not any((c.kind == ELEMENT and id(c) not in gone) or (c.kind == TEXT and c.name.strip()) for c in n.children):
            gone.add(id(n))
    prune([n for n in nodes if id(n) in gone])


def _signatures(root: Node) -> dict[int, bytes]:
    """Of every element a digest of its name, attributes and content, texts trimmed."""
    made: dict[int, bytes] = {}
    for n in reversed(list(root.walk())):
        if n.kind == ELEMENT:
            h = hashlib.blake2b(repr((n.name, n.attrs)).encode("utf-8", "surrogatepass"), digest_size=16)
            for c in n.children:
                if c.kind == ELEMENT:
                    h.update(b"e" + made[id(c)])
                elif c.kind == TEXT and c.name.strip():
                    h.update(b"t" + hashlib.blake2b(c.name.strip().encode("utf-8", "surrogatepass"), digest_size=16).digest())
            made[id(n)] = h.digest()
    return made


def remove_repeats(root: Node) -> None:
    """Of equal siblings the first stays. Headings and landmarks may repeat, and so may all in code blocks."""
    if any(a.name in ("pre", "code") for a in (root, *root.ancestors())):
        return
    # taken from the leaves up before anything goes: what is removed below two equal siblings is equal too
    signature = _signatures(root)
    todo = [root]
    while todo:
        n = todo.pop()
        seen, kept = set(), []
        for c in n.children:
            if c.kind == ELEMENT and c.name not in NEVER_REPEATED and c.name not in ("pre", "code"):
                if signature[id(c)] in seen:
                    c.parent = None
                    continue
                seen.add(signature[id(c)])
            kept.append(c)
        n.children = kept
        todo.extend(c for c in kept if c.kind == ELEMENT and c.name not in ("pre", "code"))


def links(root: Node) -> list[str]:
    """Raw targets of the links, each once, in document order: web links and relative ones."""
    out: dict[str, None] = {}
    for n in root.elements():
        if n is root or n.name != "a":
            continue
        raw = n.get("href")
        if raw is None or not raw.strip() or raw.strip().startswith("#"):
            continue
        try:
            scheme = urlsplit(raw.strip()).scheme
        except ValueError:
            continue
        if scheme in ("", "http", "https"):
            out[raw] = None
    return list(out)


def sanitize(root: Node | None) -> Sanitized:
    if root is None or not any(c.kind != COMMENT for c in root.children):
        return Sanitized(None, cause=UNPARSEABLE)
    if cause := repairable(root):
        return Sanitized(None, cause=cause)
    linearize_tabs(root)
    renumber_headings(root)
    remove_eyebrows(root)
    remove_hidden(root)
    remove_empty(root)
    remove_repeats(root)
    return Sanitized(root, links(root))
