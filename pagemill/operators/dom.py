"""A small HTML tree: parser, serializer and CSS selectors. Pure Python, used inside the document map only.

The parser builds the tree that browsers build from a page's body: implied html, head, body, tbody and tr, void
elements, elements that end others, raw text, formatting that goes on in the next paragraph where it wasn't closed
and is taken apart where it overlaps blocks, and content that stands loose in a table before it. Of formatting
elements open at once the last ``MAX_FORMATTING`` go on. Frames, foreign content (svg, math) and template contents
have no rules of their own.

Everything here is linear in the page, whatever its nesting: tokens are read in one pass that never goes back,
open elements are found by name, not by a walk up the stack, and nothing recurses.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import escape, unescape

DOCUMENT, ELEMENT, TEXT, COMMENT = range(4)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
HEAD_ONLY = frozenset("title meta link base script style noscript template".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_END = frozenset("address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer form header hgroup listing main menu nav ol pre search section summary ul".split())
ENDS_P = (BLOCK_END - {"button"}) | frozenset(("hr", "p", "li", "dd", "dt", "xmp", "plaintext", *HEADINGS))
SPECIAL = BLOCK_END | frozenset((*HEADINGS, *VOID, *RAW, *RCDATA, *"applet body caption colgroup dd dt frame frameset head html li marquee noscript object p plaintext script select table tbody td template tfoot th thead tr".split()))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKED = frozenset(("applet", "marquee", "object", "td", "th", "caption", "template"))
SCOPE = frozenset("applet caption html table td th marquee object template".split())
ITEM_BARRIER = SPECIAL - {"address", "div", "p"}
NO_FORMATTING = ENDS_P | RAW | RCDATA | HEAD_ONLY | frozenset(("table", "param", "source", "track", "frame"))  # these begin without the formatting that is still on
SECTIONS, CELLS, IN_TABLE = ("tbody", "thead", "tfoot"), ("td", "th"), ("table", "tbody", "thead", "tfoot", "tr")
TABLE_PARTS = frozenset(("caption", "colgroup", "col", *SECTIONS, "tr", *CELLS))
MAX_FORMATTING = 16


class Node:
    __slots__ = ("attrs", "children", "kind", "name", "parent")

    def __init__(self, kind: int, name: str = "", attrs: list[tuple[str, str]] | None = None) -> None:
        self.kind, self.name, self.attrs = kind, name, attrs or []
        self.children: list[Node] = []
        self.parent: Node | None = None

    def get(self, key: str) -> str | None:
        for k, v in self.attrs:
            if k == key:
                return v
        return None

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order; children are read as the walk reaches them."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.kind == ELEMENT)

    def text(self) -> str:
        return "".join(n.name for n in self.walk() if n.kind == TEXT)

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def inside(self, other: Node) -> bool:
        return self is other or any(a is other for a in self.ancestors())

    def clone(self) -> Node:
        top = Node(self.kind, self.name, list(self.attrs))
        todo = [(self, top)]
        while todo:
            source, made = todo.pop()
            for c in source.children:
                copy = Node(c.kind, c.name, list(c.attrs))
                made.append(copy)
                todo.append((c, copy))
        return top


def _detach(node: Node) -> None:
    """Takes a node from its parent, whose last child it mostly is."""
    siblings = node.parent.children
    at = len(siblings) - 1
    while siblings[at] is not node:
        at -= 1
    del siblings[at]


def prune(nodes: Iterable[Node]) -> None:
    """Takes the nodes out of the tree, each list of children made anew once however many of it go."""
    gone, parents = set(), {}
    for n in nodes:
        if n.parent is not None:
            gone.add(id(n))
            parents[id(n.parent)] = n.parent
    for parent in parents.values():
        for c in parent.children:
            if id(c) in gone:
                c.parent = None
        parent.children = [c for c in parent.children if id(c) not in gone]


_MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
_NAME = re.compile(r"[^\s/>]*", re.A)
_GAP = re.compile(r"[\s/]*", re.A)
_ATTR = re.compile(r"(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?", re.A)
_SHORT_COMMENT = re.compile(r"-?>")
_COMMENT_END = re.compile(r"--!?>")


def _attributes(source: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes of the tag that goes on at ``at``, each name once, and where it ends; -1 if it never does."""
    out, seen, n = [], set(), len(source)
    while True:
        at = _GAP.match(source, at).end()
        if at >= n:
            return out, -1
        if source[at] == ">":
            return out, at + 1
        m = _ATTR.match(source, at)
        at = m.end()
        key = m[1].lower()
        if key not in seen:
            seen.add(key)
            value = next((v for v in m.group(2, 3, 4) if v is not None), "")
            out.append((key, unescape(value) if "&" in value else value))


class _Builder:
    """Open elements in a stack, and for each name where it stands in it; formatting elements that are on, with a
    None where a cell or the like began."""

    def __init__(self) -> None:
        self.document = Node(DOCUMENT)
        self.html, self.head, self.body = Node(ELEMENT, "html"), Node(ELEMENT, "head"), Node(ELEMENT, "body")
        self.document.append(self.html)
        self.html.append(self.head)
        self.html.append(self.body)
        self.stack = [self.html, self.head]
        self.open: dict[str, list[int]] = {}  # places from 2 on
        self.on: set[int] = set()  # ids of what is in the stack from 2 on
        self.formatting: list[Node | None] = []
        self.in_body = False
        self.quirks = True
        self.loose: list[str] = []  # text of the innermost open element that isn't in the tree yet

    def flush(self) -> None:
        if self.loose:
            raw, parent = "".join(self.loose), self.stack[-1]
            self.loose.clear()
            if parent.children and parent.children[-1].kind == TEXT:
                parent.children[-1].name += raw
            else:
                parent.append(Node(TEXT, raw))

    def enter_body(self) -> None:
        if not self.in_body:
            self.flush()
            self.in_body = True
            self.stack = [self.html, self.body]
            self.open.clear()
            self.on.clear()

    def insert(self, node: Node) -> None:
        """Into the innermost open element; what doesn't belong into a table goes before it."""
        self.flush()
        top = self.stack[-1]
        if top.name not in IN_TABLE:
            top.append(node)
            return
        table = self.stack[self.innermost(("table",))]
        node.parent = table.parent
        siblings = table.parent.children
        at = len(siblings) - 1
        while siblings[at] is not table:
            at -= 1
        if node.kind == TEXT and at and siblings[at - 1].kind == TEXT:
            siblings[at - 1].name += node.name
        else:
            siblings.insert(at, node)

    def text(self, raw: str) -> None:
        if not raw:
            return
        top = self.stack[-1]
        if not self.in_body and top is self.head:
            if not raw.strip():
                return
            self.enter_body()
        if top.name in ("pre", "listing") and not top.children and not self.loose and raw[0] == "\n":
            raw = raw[1:]
        if self.in_body and top.name in IN_TABLE and raw.strip():
            self.resume()
            if self.stack[-1] is top:
                self.insert(Node(TEXT, raw))
                return
        elif self.in_body and self.formatting and top.name not in IN_TABLE:
            self.resume()
        self.loose.append(raw)

    def cut(self, place: int) -> None:
        """Ends the open element at a place of the stack, and all inside it."""
        if place >= len(self.stack):
            return
        self.flush()
        for n in reversed(self.stack[place:]):
            self.open[n.name].pop()
            self.on.discard(id(n))
            if n.name in MARKED and None in self.formatting:
                while self.formatting.pop() is not None:
                    pass
        del self.stack[place:]

    def innermost(self, names: Iterable[str]) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def close_first(self, names: Iterable[str], barrier: Iterable[str]) -> None:
        """Ends the innermost open element of ``names``, with all inside it, unless a barrier comes first."""
        place = self.innermost(names)
        if place and place >= self.innermost(barrier):
            self.cut(place)

    def push(self, node: Node) -> None:
        self.open.setdefault(node.name, []).append(len(self.stack))
        self.on.add(id(node))
        self.stack.append(node)

    def add(self, node: Node) -> None:
        self.insert(node)
        self.push(node)

    def add_part(self, node: Node) -> None:
        """A part of a table, whose place is right there."""
        self.flush()
        self.stack[-1].append(node)
        self.push(node)

    # ------------------------------------------------------------ formatting

    def format_on(self, node: Node) -> None:
        since = len(self.formatting)
        while since and self.formatting[since - 1] is not None:
            since -= 1
        same = [k for k in range(since, len(self.formatting)) if self.formatting[k].name == node.name and self.formatting[k].attrs == node.attrs]
        if len(same) > 2:
            del self.formatting[same[0]]
        elif len(self.formatting) - since >= MAX_FORMATTING:
            del self.formatting[since]
        self.formatting.append(node)

    def resume(self) -> None:
        """Formatting that is on but not open any more begins again here."""
        k = len(self.formatting)
        while k and self.formatting[k - 1] is not None and id(self.formatting[k - 1]) not in self.on:
            k -= 1
        for j in range(k, len(self.formatting)):
            again = Node(ELEMENT, self.formatting[j].name, list(self.formatting[j].attrs))
            self.add(again)
            self.formatting[j] = again

    def _on_now(self, name: str) -> int:
        """Where the last formatting element of that name stands since the last mark; -1 if none does."""
        for k in range(len(self.formatting) - 1, -1, -1):
            if self.formatting[k] is None:
                return -1
            if self.formatting[k].name == name:
                return k
        return -1

    def _place(self, node: Node) -> int:
        places = self.open[node.name]
        for k in range(len(places) - 1, -1, -1):
            if self.stack[places[k]] is node:
                return places[k]
        raise LookupError(node.name)

    def _restack(self, at: int, stop: int, nodes: list[Node]) -> None:
        """Puts nodes in place of those from at to stop in the stack."""
        if len(nodes) != stop - at:
            nodes, stop = [*nodes, *self.stack[stop:]], len(self.stack)
        for k in range(stop - 1, at - 1, -1):
            n = self.stack[k]
            places = self.open[n.name]
            del places[bisect_left(places, k)]
            self.on.discard(id(n))
        self.stack[at:stop] = nodes
        for k, n in enumerate(nodes, at):
            insort(self.open.setdefault(n.name, []), k)
            self.on.add(id(n))

    def format_off(self, name: str) -> None:
        """The end of a formatting element: blocks that began inside it and go on are taken out, with a copy of it inside them."""
        if self.stack[-1].name == name and len(self.stack) > 2 and not any(n is self.stack[-1] for n in self.formatting):
            self.cut(len(self.stack) - 1)
            return
        for _ in range(8):
            listed = self._on_now(name)
            if listed < 0:
                self.close_first((name,), SPECIAL)
                return
            element = self.formatting[listed]
            if id(element) not in self.on:
                del self.formatting[listed]
                return
            at = self._place(element)
            if at < self.innermost(SCOPE):
                return
            self.flush()
            blocks = [places[k] for x in SPECIAL if (places := self.open.get(x)) and (k := bisect_right(places, at)) < len(places)]
            if not blocks:
                self.cut(at)
                self.formatting.remove(element)
                return
            block_at = min(blocks)
            block, above = self.stack[block_at], self.stack[at - 1]
            mark, last, kept = listed, block, []
            for count, node in enumerate(reversed(self.stack[at + 1 : block_at]), 1):
                where = next((k for k, n in enumerate(self.formatting) if n is node), -1)
                if count > 3 and where >= 0:
                    del self.formatting[where]
                    mark -= where < mark
                    where = -1
                if where < 0:
                    continue
                copy = Node(ELEMENT, node.name, list(node.attrs))
                self.formatting[where] = copy
                kept.append(copy)
                if last is block:
                    mark = where + 1
                _detach(last)
                copy.append(last)
                last = copy
            _detach(last)
            if above.name in IN_TABLE:
                rest, self.stack = self.stack, self.stack[:at]
                self.insert(last)
                self.stack = rest
            else:
                above.append(last)
            again = Node(ELEMENT, element.name, list(element.attrs))
            for c in block.children:
                again.append(c)
            block.children = []
            block.append(again)
            here = next(k for k, n in enumerate(self.formatting) if n is element)
            del self.formatting[here]
            self.formatting.insert(mark - (here < mark), again)
            self._restack(at, block_at + 1, [*reversed(kept), block, again])

    # ------------------------------------------------------------------ tags

    def _table_part(self, name: str, attrs: list[tuple[str, str]]) -> None:
        table = self.innermost(("table",))
        if not table:
            return
        if name in ("tr", *CELLS):
            row = self.innermost(("tr",))
            if name != "tr" and row > table:
                self.cut(row + 1)
            else:
                section = self.innermost(SECTIONS)
                if section > table:
                    self.cut(section + 1)
                else:
                    self.cut(table + 1)
                    self.add_part(Node(ELEMENT, "tbody"))
                if name != "tr":
                    self.add_part(Node(ELEMENT, "tr"))
        elif name != "col" or self.stack[-1].name != "colgroup":
            self.cut(table + 1)
            if name == "col":
                self.add_part(Node(ELEMENT, "colgroup"))
        if name == "col":
            self.stack[-1].append(Node(ELEMENT, name, attrs))
            return
        self.add_part(Node(ELEMENT, name, attrs))
        if name in MARKED:
            self.formatting.append(None)

    def start(self, name: str, attrs: list[tuple[str, str]]) -> None:
        if name in ("html", "body", "head"):
            node = {"html": self.html, "body": self.body, "head": self.head}[name]
            have = {k for k, _ in node.attrs}
            node.attrs += [a for a in attrs if a[0] not in have]
            if name == "body":
                self.enter_body()
            return
        if not self.in_body and name not in HEAD_ONLY:
            self.enter_body()
        if name in TABLE_PARTS:
            self._table_part(name, attrs)
            return
        if name in ENDS_P or (name == "table" and not self.quirks):
            self.close_first(("p",), SCOPE | {"button"})
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.cut(len(self.stack) - 1)
        elif name == "li":
            self.close_first(("li",), ITEM_BARRIER)
        elif name in ("dt", "dd"):
            self.close_first(("dt", "dd"), ITEM_BARRIER)
        elif name in ("option", "optgroup"):
            self.close_first(("option",) if name == "option" else ("option", "optgroup"), SPECIAL)
        elif name == "button":
            self.close_first(("button",), SCOPE)
        elif name == "a" and (k := self._on_now("a")) >= 0:
            before = self.formatting[k]
            self.format_off("a")
            self.formatting = [n for n in self.formatting if n is not before]
            if id(before) in self.on:
                at = self._place(before)
                self._restack(at, at + 1, [])
        elif name == "table" and (table := self.innermost(("table",))) and table > self.innermost((*CELLS, "caption")):
            self.cut(table)
        if name not in NO_FORMATTING and self.in_body and self.formatting:
            self.resume()
        node = Node(ELEMENT, name, attrs)
        if name in VOID:
            self.insert(node)
            return
        if name in ("script", "style", "template") and self.stack[-1].name in IN_TABLE:
            self.add_part(node)
        else:
            self.add(node)
        if name in FORMATTING:
            self.format_on(node)
        elif name in MARKED:
            self.formatting.append(None)

    def comment(self, raw: str) -> None:
        self.flush()
        (self.stack[-1] if self.in_body or self.stack[-1] is not self.head else self.document).append(Node(COMMENT, raw))

    def end(self, name: str) -> None:
        if name == "head":
            return
        if name in ("body", "html"):
            self.enter_body()
        elif name == "br":
            self.start("br", [])
        elif name == "p":
            if self.innermost(("p",)) <= self.innermost(SCOPE | {"button"}):
                self.start("p", [])
            self.close_first(("p",), SCOPE | {"button"})
        elif name in FORMATTING:
            self.format_off(name)
        elif name in HEADINGS:
            self.close_first(HEADINGS, SCOPE)
        elif name == "li":
            self.close_first(("li",), SCOPE | {"ol", "ul"})
        elif name == "table":
            self.close_first(("table",), ())
        elif name in TABLE_PARTS:
            self.close_first((name,), ("table",))
        elif name in BLOCK_END or name in ("dd", "dt") or name in MARKED:
            self.close_first((name,), SCOPE)
        else:
            self.close_first((name,), SPECIAL)

    def raw(self, inner: str) -> None:
        """The text of the element just begun, which ends with it."""
        if inner:
            self.stack[-1].append(Node(TEXT, inner))
        self.cut(len(self.stack) - 1)


def parse(source: str) -> Node:
    """The document of any text; there are always an html, a head and a body element. A tag that the text ends in is no tag."""
    b, at, n = _Builder(), 0, len(source)
    while at < n:
        m = _MARKUP.search(source, at)
        if m is None:
            break
        if m.start() > at:
            b.text(unescape(source[at : m.start()]))
        at = m.start()
        if source.startswith("<!--", at):
            short = _SHORT_COMMENT.match(source, at + 4)
            stop = short or _COMMENT_END.search(source, at + 4)
            b.comment("" if short else source[at + 4 : stop.start() if stop else n])
            at = stop.end() if stop else n
            continue
        close = source[at + 1] == "/"
        begin = at + 1 + close
        if not source[begin : begin + 1].isascii() or not source[begin : begin + 1].isalpha():
            if close and begin >= n:
                break  # the slash stands at the very end: text
            stop = source.find(">", begin)
            stop = n if stop < 0 else stop
            if source[begin : begin + 8].lower() == "!doctype":
                b.quirks &= b.in_body or bool(b.head.children)
            elif not (close and stop == begin):
                b.comment(source[begin + (source[begin : begin + 1] == "!") : stop])
            at = stop + 1
            continue
        name_end = _NAME.match(source, begin).end()
        name = source[begin:name_end].lower()
        attrs, at = _attributes(source, name_end)
        if at < 0:
            at = n
            break
        if close:
            b.end(name)
            continue
        b.start(name, attrs)
        if name in RAW or name in RCDATA:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I | re.A).search(source, at)
            inner = source[at : stop.start() if stop else n]
            b.raw(unescape(inner) if name in RCDATA else inner)
            at = source.find(">", stop.end()) + 1 if stop else n
            if not at:
                at = n
    if at < n:
        b.text(unescape(source[at:]))
    b.flush()
    return b.document


def serialize(node: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.kind == TEXT:
            raw = x.parent is not None and x.parent.name in RAW
            out.append(x.name if raw else escape(x.name, quote=False))
        elif x.kind == COMMENT:
            out.append(f"<!--{x.name}-->")
        else:
            if x.kind == ELEMENT:
                out.append("<" + x.name + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs) + ">")
                if x.name in VOID:
                    continue
                todo.append(f"</{x.name}>")
            todo.extend(reversed(x.children))
    return "".join(out)


# ------------------------------------------------------------------ selectors

_SIMPLE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<key>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^)]*)\))?")
Test = Callable[[Node], bool]


def _attribute_test(key: str, op: str | None, want: str) -> Test:
    def test(n: Node) -> bool:
        have = n.get(key)
        if have is None:
            return False
        match op:
            case None:
                return True
            case "=":
                return have == want
            case "~=":
                return want in have.split()
            case "|=":
                return have == want or have.startswith(want + "-")
            case "^=":
                return bool(want) and have.startswith(want)
            case "$=":
                return bool(want) and have.endswith(want)
        return bool(want) and want in have

    return test


def _siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if c.kind == ELEMENT] if n.parent is not None else [n]


def _compound(source: str) -> Test:
    tests: list[Test] = []
    at = 0
    while at < len(source):
        m = _SIMPLE.match(source, at)
        if not m:
            raise ValueError(f"bad selector {source!r}")
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                tests.append(lambda n, t=m["tag"].lower(): n.name == t)
        elif m["id"]:
            tests.append(lambda n, i=m["id"]: n.get("id") == i)
        elif m["cls"]:
            tests.append(lambda n, c=m["cls"]: c in (n.get("class") or "").split())
        elif m["key"]:
            want = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
            tests.append(_attribute_test(m["key"].lower(), m["op"], want))
        elif m["pseudo"] == "not" and m["arg"]:
            tests.append(lambda n, inner=_compound(m["arg"].strip()): not inner(n))
        elif m["pseudo"] == "first-child":
            tests.append(lambda n: _siblings(n)[0] is n)
        elif m["pseudo"] == "last-child":
            tests.append(lambda n: _siblings(n)[-1] is n)
        elif m["pseudo"] == "empty":
            tests.append(lambda n: not any(c.kind in (ELEMENT, TEXT) for c in n.children))
        else:
            raise ValueError(f"unknown selector {m[0]!r}")
    return lambda n: all(t(n) for t in tests)


def _split(source: str, by: str) -> list[str]:
    out, depth, quote, last = [], 0, "", 0
    for k, c in enumerate(source):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == by and not depth:
            out.append(source[last:k])
            last = k + 1
    return [*out, source[last:]]


@lru_cache(maxsize=512)
def selector(source: str) -> Test:
    """A test for elements: groups, the four combinators, tags, ids, classes, attributes, :not and a few more."""
    if "," in source and len(_split(source, ",")) > 1:
        parts = [selector(s.strip()) for s in _split(source, ",")]
        return lambda n: any(p(n) for p in parts)
    steps: list[tuple[str, Test]] = []
    for m in re.finditer(r"\s*([>+~]?)\s*((?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[\(])+)", source.strip()):
        steps.append((m[1] or " ", _compound(m[2])))
    if not steps:
        raise ValueError("empty selector")

    def matches(n: Node | None, k: int) -> bool:
        if n is None or n.kind != ELEMENT or not steps[k][1](n):
            return False
        if k == 0:
            return True
        how = steps[k][0]
        if how == ">":
            return matches(n.parent, k - 1)
        if how == " ":
            return any(matches(a, k - 1) for a in n.ancestors())
        before = _siblings(n)
        before = before[: next(i for i, s in enumerate(before) if s is n)]
        return matches(before[-1], k - 1) if how == "+" and before else how == "~" and any(matches(s, k - 1) for s in before)

    return lambda n: matches(n, len(steps) - 1)


def find_all(root: Node, source: str) -> list[Node]:
    """Matching descendants (never ``root`` itself), in document order."""
    test = selector(source)
    return [n for n in root.elements() if n is not root and test(n)]


def find(root: Node, source: str) -> Node | None:
    test = selector(source)
    return next((n for n in root.elements() if n is not root and test(n)), None)
