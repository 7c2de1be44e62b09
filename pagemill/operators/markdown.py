"""HTML to Markdown, and the checks that the Markdown of a document must pass. Per-document, pure Python.

Structure is kept and nothing is guessed: bold paragraphs don't become headings, code without a language gets
none, addresses stay as written.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterable
from dataclasses import dataclass, field

from .dom import COMMENT, ELEMENT, HEADINGS, TEXT, Node

FAILED = "conversion failed"
EMPTY, BROKEN_H1, ORPHAN = "empty markdown content", "broken H1 invariant", "orphan content outside root hierarchy"
SKIPPED, EMPTY_SECTION, NO_TITLE = "skipped heading levels", "empty section", "title extraction failed"

_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table ul".split()
)
_IGNORED = frozenset("script style head title template noscript iframe svg input select textarea".split())
_SPACE = re.compile(r"[ \t\r\n\f]+")


# ------------------------------------------------------------------- writing


def _escape(text: str) -> str:
    return re.sub(r"([\\*_`\[\]])", r"\\\1", text)


def _piece(n: Node) -> str | None:
    """What an inline node without a mark of its own around its children gives; None if its children say."""
    if n.kind == TEXT:
        return _escape(_SPACE.sub(" ", n.name))
    if n.kind == COMMENT or n.name in _IGNORED:
        return ""
    if n.name == "br":
        return "  \n"
    if n.name == "img":
        src = n.get("src") or ""
        title = f' "{n.get("title")}"' if n.get("title") else ""
        return f"![{_SPACE.sub(' ', n.get('alt') or '')}]({src}{title})" if src else ""
    if n.name in ("code", "kbd", "samp", "tt"):
        text = _SPACE.sub(" ", n.text())
        if not text.strip():
            return ""
        ticks = "`" * (1 + max((len(t) for t in re.findall("`+", text)), default=0))
        pad = " " if text[0] == "`" or text[-1] == "`" else ""
        return f"{ticks}{pad}{text}{pad}{ticks}"
    return None


def _marks(n: Node) -> tuple[str, str] | None:
    if n.name == "a" and n.get("href") is not None:
        title = f' "{n.get("title")}"' if n.get("title") else ""
        return "[", f"]({n.get('href')}{title})"
    if n.name in ("strong", "b"):
        return "**", "**"
    return ("*", "*") if n.name in ("em", "i") else None


def _inline(nodes: Iterable[Node]) -> str:
    """Inline nodes one after the other. Marks go inside the blanks at either end, as one next to a blank means
    nothing, and an element of blanks gets none: opening marks wait for the first text that isn't blank, and
    blanks wait for what comes after them. Bold in bold is marked once, as is emphasis."""
    out: list[str] = []
    on: set[str] = set()
    blanks: list[str] = []
    waiting: list[str] = []  # opening marks whose element has no text yet
    todo: list[Node | str] = list(nodes)[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):  # the end of a marked element
            on.discard(x)
            if waiting:
                waiting.pop()
            else:
                out.append(x)
            continue
        text = _piece(x)
        if text is None:
            marks = _marks(x)
            if marks and marks[1] not in on:
                on.add(marks[1])
                waiting.append(marks[0])
                todo.append(marks[1])
            todo.extend(reversed(x.children))
        elif core := text.strip():
            at = text.index(core)
            out += [*blanks, text[:at], *waiting, core]
            waiting.clear()
            blanks = [text[at + len(core) :]]
        else:
            blanks.append(text)
    return "".join(out + blanks)


def _paragraph(text: str) -> str:
    lines = [re.sub(r" {2,}(?!\n|$)", " ", line.lstrip()) for line in text.strip().split("\n")]
    text = "\n".join(x if k == len(lines) - 1 else x.rstrip() + "  " for k, x in enumerate(lines)).rstrip()
    # what would begin another block at the start of a line
    return re.sub(r"(?m)^(#{1,6}(?= )|[-+](?= )|>|\d+(?=[.)] )|-{3,}$|={3,}$)", lambda m: (m[0] + "\\") if m[0][0].isdigit() else "\\" + m[0], text)


def _fence(n: Node) -> str:
    code = next((c for c in n.children if c.kind == ELEMENT and c.name == "code"), None)
    info = ""
    for source in (code, n):
        for name in (source.get("class") or "").split() if source is not None else ():
            if not info and name.startswith(("language-", "lang-")):
                info = name.split("-", 1)[1]
    parts = []
    for x in n.walk():
        if x.kind == TEXT:
            parts.append(x.name)
        elif x.name == "br":
            parts.append("\n")
    text = "".join(parts).removeprefix("\n").rstrip("\n")
    ticks = "`" * max(3, 1 + max((len(t) for t in re.findall("`+", text)), default=0))
    return f"{ticks}{info}\n{text}\n{ticks}"


class TooDeep(ValueError):
    """Lists and quotes in one another beyond ``MAX_NESTING``: every one indents all that it holds."""


MAX_NESTING = 1000
_Step = Generator["_Step", object, object]


def _flat(nodes: Iterable[Node]) -> str:
    """Inline text on one line."""
    return " ".join(_inline(nodes).replace("  \n", " ").split())


def _list(n: Node, holding: set[int]) -> _Step:
    items = [c for c in n.children if c.kind == ELEMENT]
    start = n.get("start") or "1"
    number = int(start) if re.fullmatch("[0-9]{1,9}", start) else 1
    out, loose = [], False
    for k, item in enumerate(items):
        mark = f"{number + k}. " if n.name == "ol" else "- "
        blocks = [(yield _list(item, holding))] if item.name in ("ul", "ol") else (yield _blocks(item, holding))
        nested = sum(b.kind == ELEMENT and b.name in ("p", "pre", "blockquote", "table") for b in item.children)
        loose |= nested > 1 or bool(nested and len(blocks) > 1)
        body = ("\n\n" if loose else "\n").join(blocks)
        pad = " " * len(mark)
        out.append(mark + "\n".join(pad + x if i and x else x for i, x in enumerate(body.split("\n"))))
    return ("\n\n" if loose else "\n").join(out)


def _rows(table: Node) -> list[Node]:
    """The rows of a table, without those of tables in it."""
    out, todo = [], list(reversed(table.children))
    while todo:
        n = todo.pop()
        if n.kind == ELEMENT and n.name == "tr":
            out.append(n)
        if n.name != "table":
            todo.extend(reversed(n.children))
    return out


def _table(n: Node) -> str:
    cells = [[c for c in r.children if c.kind == ELEMENT and c.name in ("td", "th")] for r in _rows(n)]
    grid = [[_flat(c.children).replace("|", "\\|") for c in r] for r in cells]
    pairs = [(r, g) for r, g in zip(cells, grid, strict=True) if g]
    if not pairs:
        return ""
    width = max(len(g) for _, g in pairs)
    headed = any(c.name == "th" for c in pairs[0][0]) or (pairs[0][0][0].parent.parent is not None and pairs[0][0][0].parent.parent.name == "thead")
    body = [g for _, g in pairs]
    head = body.pop(0) if headed else [" "] * width
    line = lambda g: "| " + " | ".join([*g, *[""] * (width - len(g))]) + " |"
    first = line(head) if headed else "|" + "|".join(["   "] * width) + "|"
    return "\n".join([first, "|" + "|".join(["---"] * width) + "|", *map(line, body)])


def _blocks(n: Node, holding: set[int]) -> _Step:
    """The blocks that an element's content makes; loose text between blocks is a paragraph of its own. ``holding`` are the nodes with blocks below them."""
    out: list[str] = []
    run: list[Node] = []

    def flush() -> None:
        if run:
            text = _paragraph(_inline(run))
            if text:
                out.append(text)
            run.clear()

    todo: list[Node | None] = list(reversed(n.children))
    while todo:
        c = todo.pop()
        if c is None:  # the end of a container
            flush()
        elif c.kind != ELEMENT or (c.name not in _BLOCK and id(c) not in holding):
            run.append(c)
        else:
            flush()
            if c.name in _IGNORED:
                continue
            if c.name in HEADINGS:
                if text := _flat(c.children):
                    out.append("#" * int(c.name[1]) + " " + text)
            elif c.name == "pre":
                out.append(_fence(c))
            elif c.name in ("ul", "ol", "menu"):
                if text := (yield _list(c, holding)):
                    out.append(text)
            elif c.name == "blockquote":
                if inner := "\n\n".join((yield _blocks(c, holding))):
                    out.append("\n".join(("> " + x).rstrip() for x in inner.split("\n")))
            elif c.name == "hr":
                out.append("* * *")
            elif c.name == "table":
                if text := _table(c):
                    out.append(text)
            else:
                todo.append(None)
                todo.extend(reversed(c.children))
    flush()
    return out


def _finished(step: _Step) -> object:
    """The result of a step that yields the steps it waits for, without recursion."""
    stack, value = [step], None
    while True:
        try:
            stack.append(stack[-1].send(value))
            value = None
            if len(stack) > 2 * MAX_NESTING:  # a list is two steps
                raise TooDeep(f"more than {MAX_NESTING} lists and quotes in one another")
        except StopIteration as done:
            stack.pop()
            value = done.value
            if not stack:
                return value


def to_markdown(root: Node) -> str:
    holder = Node(ELEMENT, "div")
    holder.children = [root] if root.kind == ELEMENT and root.name in _BLOCK else list(root.children)
    holding: set[int] = set()
    for n in reversed(list(holder.walk())):
        if any(c.kind == ELEMENT and (c.name in _BLOCK or id(c) in holding) for c in n.children):
            holding.add(id(n))
    return "\n\n".join(_finished(_blocks(holder, holding)))


def link_refs(root: Node) -> list[tuple[str, str]]:
    """(raw, kind) of links and images in document order, repeats included."""
    out = []
    for n in root.elements():
        raw = n.get("href") if n.name == "a" else n.get("src") if n.name == "img" else None
        if raw is not None:
            out.append((raw, "image" if n.name == "img" else "anchor" if raw.startswith("#") else "navigation"))
    return out


# ------------------------------------------------------------------ checking


@dataclass
class Heading:
    level: int
    text: str
    content: bool = False


@dataclass
class Outline:
    headings: list[Heading] = field(default_factory=list)
    orphan: bool = False  # text, list, table or quote before the first heading; a code block is none


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")


def outline(markdown: str) -> Outline:
    out = Outline()
    fence, blank, paragraph = "", True, False

    def content(code: bool = False) -> None:
        if out.headings:
            out.headings[-1].content = True
        elif not code:
            out.orphan = True

    lines = markdown.split("\n")
    for k, line in enumerate(lines):
        if fence:
            if re.fullmatch(rf" {{0,3}}{fence[0]}{{{len(fence)},}}[ \t]*", line):
                fence = ""
            continue
        if not line.strip():
            blank, paragraph = True, False
            continue
        if m := _FENCE.match(line):
            fence, paragraph, blank = m[1], False, False
            content(code=True)
        elif m := _ATX.match(line):
            text = line[m.end() :].strip(" \t")
            open_ = text.rstrip("#")
            text = (open_ if not open_ or open_[-1] in " \t" else text).strip()
            out.headings.append(Heading(len(m[1]), text, bool(text)))
            paragraph = blank = False
        elif blank and re.match(r" {4,}|\t", line) and not paragraph:
            content(code=True)
        elif re.fullmatch(r" {0,3}([-*_])[ \t]*(\1[ \t]*){2,}", line) and not paragraph:
            blank = False
        else:
            after = lines[k + 1] if k + 1 < len(lines) else ""
            if not paragraph and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", after) and not re.match(r" {0,3}([-*+]|\d+[.)]|>|\|)", line):
                out.headings.append(Heading(1 if "=" in after else 2, line.strip(), True))
            elif not (out.headings and paragraph is False and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line)):
                content()
                paragraph = True
            blank = False
    return out


def check(markdown: str, strict_empty_sections: bool = False) -> str | None:
    """The first rule that a document breaks, or None. A heading's own text counts as content of its section, unless strict."""
    if not markdown.strip():
        return EMPTY
    found = outline(markdown)
    levels = [h.level for h in found.headings]
    if levels.count(1) != 1:
        return BROKEN_H1
    if found.orphan:
        return ORPHAN
    if any(b > a + 1 for a, b in zip(levels, levels[1:], strict=False)):
        return SKIPPED
    bodies = _bodies(markdown) if strict_empty_sections else [h.content for h in found.headings]
    least = 7  # the highest level that comes later
    for level, full in zip(reversed(levels), reversed(bodies), strict=True):
        if not full and least <= level:
            return EMPTY_SECTION
        least = min(least, level)
    return None


def _bodies(markdown: str) -> list[bool]:
    """Whether anything but deeper headings stands under each heading."""
    out: list[bool] = []
    for part in re.split(r"(?m)^(?= {0,3}#{1,6}(?:[ \t]|$))", markdown):
        if _ATX.match(part.split("\n", 1)[0]):
            out.append(bool(part.partition("\n")[2].strip()))
    return out


def title(markdown: str) -> str | None:
    """Text of the first line that starts like an h1, less inline marks; addresses of links stay."""
    for line in markdown.split("\n"):
        if line.strip().startswith("# "):
            found = re.sub(r"`|\*\*|__|[*_\[\]]", "", line.strip()[2:]).strip()
            return found or None
    return None
