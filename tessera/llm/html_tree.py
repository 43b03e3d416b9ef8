"""A tolerant HTML reader: elements, text and the blocks of text below an element.

Every input gives a tree: unclosed and stray tags, raw-text elements, comments, cut-off tags and
character references are handled as browsers do in outline, without the full tree-building rules.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key's set closes an open element of the named kinds.
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option li dd dt".split()) | frozenset(("li", "dd", "dt"))
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Element:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)


def parse(source: str) -> Element:
    root = Element("#root")
    stack = [root]
    at, end = 0, len(source)

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece))

    def close(names: set[str] | frozenset[str], within: set[str] | frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in within:
                return

    while at < end:
        found = TOKEN.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["close"]:
            if name == "br":
                stack[-1].children.append(Element("br"))
            close({name}, frozenset() if name in BLOCK else BLOCK - {"p"})
            continue
        if name in CLOSES_P:
            close({"p"}, {"table", "td", "th", "article", "section", "div", "blockquote", "li", "main", "aside", "form", "fieldset", "dd", "figure"})
        if name in CLOSED_BY:
            close(*CLOSED_BY[name])
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(ATTR.findall(found["attrs"]))} if found["attrs"].strip() else {}
        element = Element(name, attrs)
        stack[-1].children.append(element)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at)
            raw = source[at : stop.start() if stop else end]
            element.children.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            at = stop.start() if stop else end
            if stop:
                at = (source.find(">", stop.end()) + 1) or end
        elif name not in VOID and not found["attrs"].rstrip().endswith("/"):
            stack.append(element)
        elif name not in VOID:  # <p/> opens an element in HTML
            stack.append(element)
    return root


def blocks(element: Element, skip) -> list[str]:
    """Texts of the blocks below ``element`` in page order, white space collapsed; ``skip(element)``
    leaves an element out.  Deep trees need no recursion."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        whole = " ".join("".join(line).split())
        if whole:
            out.append(whole)
        line.clear()

    todo: list[Element | str | None] = [element]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            line.append(node)
        elif node.name == "br":
            line.append("\n")
        elif node is element or not skip(node):
            block = node.name in BLOCK or node is element
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(node.children))
    flush()
    return out
