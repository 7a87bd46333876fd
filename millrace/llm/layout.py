"""Layout-aware rendering: HTML into the text that a reader sees, and text into the blocks of its layout."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_UNSEEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "textarea"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre"}
#: A start tag of the key ends open elements of the values, up to one of the barriers.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Around the number of a source line, before the first character of a text that comes from it.
_MARKS = ("\ufdd0", "\ufdd1")
_MARK = re.compile("\ufdd0(\\d+)\ufdd1")
_TAG = re.compile(r"<(?:!doctype|html|body|div|p|br|table|ul|ol|li|h[1-6]|span|a|nav|script)\b[^<>]*>", re.I)


class Node:
    __slots__ = ("tag", "hidden", "start", "kids")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1) -> None:
        self.tag, self.hidden, self.start, self.kids = tag, hidden, start, []


class _Builder(HTMLParser):
    def __init__(self, marked: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.marked = marked
        self.root = Node("html")
        self.open = [self.root]

    def _close(self, ends: set[str], barriers: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in barriers:
                break
            if self.open[i].tag in ends:
                del self.open[i:]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _IMPLIED:
            self._close(*_IMPLIED[tag])
        if tag in _BLOCK:
            self._close({"p"}, {"td", "th", "li", "div", "table", "button"})
        if tag == "td" or tag == "th":
            if not any(n.tag == "tr" for n in self.open):
                self.handle_starttag("tr", [])
        hidden = tag in _UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN_STYLE.search(a.get("style", "")))
        node = Node(tag, hidden, int(a["start"]) if a.get("start", "").lstrip("-").isdigit() else 1)
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
        if tag == "p":
            self.open[-1].kids.append(Node("p"))

    def handle_data(self, data):
        if self.marked:
            first = self.getpos()[0]
            data = "\n".join(re.sub(r"(?=\S)", f"{_MARKS[0]}{first + i}{_MARKS[1]}", x, count=1) for i, x in enumerate(data.split("\n")))
        self.open[-1].kids.append(data)


def is_html(text: str) -> bool:
    return bool(_TAG.search(text))


def source_lines(html: str) -> list[list[int]]:
    """For each line of render(html) the numbers (from 1) of the lines of html that its text comes from."""
    return [sorted({int(no) for no in _MARK.findall(x)}) for x in render(html, marked=True).split("\n")]


def render(html: str, marked: bool = False) -> str:
    """All visible text. Blocks stand on lines of their own, paragraphs, lists and tables with a blank line around
    them; list items have a bullet or their number, nested ones are indented; table cells are aligned in columns."""
    b = _Builder(marked)
    b.feed(html)
    b.close()
    lines: list[str] = []
    _emit(b.root, lines, "", False)
    out: list[str] = []
    for x in lines:
        x = x.rstrip()
        if x or (out and out[-1]):
            out.append(x)
    return "\n".join(out).strip("\n")


def _emit(node: Node, lines: list[str], indent: str, pre: bool) -> None:
    inline: list[str] = []

    def flush() -> None:
        text = "".join(inline)
        inline.clear()
        for part in text.split("\n") if pre else [re.sub(r"[^\S ]+| {2,}", " ", x).strip(" ") for x in text.split("\x00")]:
            if part or pre:
                lines.append(indent + part)

    def walk(n: Node) -> None:
        number = n.start
        for kid in n.kids:
            if isinstance(kid, str):
                inline.append(kid if pre else re.sub(r"[\t\r\n ]+", " ", kid))
            elif kid.hidden:
                continue
            elif kid.tag == "br":
                inline.append("\n" if pre else "\x00")
            elif kid.tag == "table":
                flush()
                lines.extend(["", *[indent + r for r in _table(kid)], ""])
            elif kid.tag == "li":
                flush()
                own: list[str] = []
                mark = f"{number}. " if n.tag == "ol" else "* "
                number += 1
                _emit(kid, own, "", pre)
                while own and not own[0]:
                    own.pop(0)
                lines.extend(indent + (mark if i == 0 else " " * len(mark)) + x for i, x in enumerate(own or [""]) if x or i == 0)
            elif kid.tag in _BLOCK:
                flush()
                if kid.tag in _SPACED:
                    lines.append("")
                _emit(kid, lines, indent + ("    " if kid.tag in ("dd", "blockquote") else ""), pre or kid.tag == "pre")
                if kid.tag in _SPACED:
                    lines.append("")
            else:
                walk(kid)

    walk(node)
    flush()


def _children(node: Node, rows: list[Node], captions: list[Node], rest: Node) -> None:
    """The rows and captions of a table, and whatever else stands in it outside of cells."""
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip() or rest.kids:
                rest.kids.append(kid)
        elif kid.hidden:
            continue
        elif kid.tag == "tr":
            rows.append(kid)
            rest.kids += [Node("br"), *(x for x in kid.kids if isinstance(x, str) and x.strip()), Node("br")]
        elif kid.tag in ("thead", "tbody", "tfoot"):
            _children(kid, rows, captions, rest)
        elif kid.tag == "caption":
            captions.append(kid)
        else:
            rest.kids.append(kid)


def _table(node: Node) -> list[str]:
    """What stands outside of cells, as browsers do before the table, then captions, then the rows."""
    rows: list[Node] = []
    captions: list[Node] = []
    rest = Node("div")
    _children(node, rows, captions, rest)
    above: list[str] = []
    for n in (rest, *captions):
        _emit(n, above, "", False)
    grid = []
    for row in rows:
        cells = []
        for cell in row.kids:
            if isinstance(cell, Node) and not cell.hidden:
                own: list[str] = []
                _emit(cell, own, "", False)
                cells.append(" ".join(x.strip() for x in own if x.strip()))
        grid.append(cells)
    widths = [max((len(r[i]) for r in grid if i < len(r)), default=0) for i in range(max(map(len, grid), default=0))]
    return [x for x in above if x.strip()] + ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in grid]
