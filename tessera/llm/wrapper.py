"""Main-text extraction by wrapper induction.

Pages of one host share a template.  A page is read as a tree of blocks: containers, and leaves that
hold text and inline markup only; neighbouring leaves of one label are one repeated leaf.  One page
of each host is its seed: the least by hash among those with the host's commonest set of structural
elements.  Every page of the host is aligned with the seed by simple tree matching: nodes match if
their labels (name, classes, id, role) do and their parents match, and a dynamic program over two
nodes' children finds the order-preserving matching with the most nodes.  A matched node takes the
seed node's place as its name, any other its parent's name and its own label, so the wrapper is the
seed with all other pages' nodes inserted.  Equal subtrees are matched whole and each pair of shapes once, so
long lists and deep pages take little more than their size.

What is counted at these names over all pages of a host, in a plain sum that has no order and drops
nothing, decides what is content:

* A text that a name shows on at least ``EVIDENCE`` different pages (told apart by 7 bits of a hash)
  and on half of the pages that have the name is template; all other texts are varying slots.  If
  only the first part of a block, up to its first inline element, is constant, just that part goes.
* The region of the article is found from the root down: the child that holds four fifths of all
  text that varies and isn't linked, until there is none or a heading stands beside it.  Element
  names only settle where to stop: at an article, or a main element without one.

Elements that never hold main text, and those whose class, id or role says that they don't, are left
out when a page is read.  A page's text is what lies in its host's region and isn't template; a page
on which the region is missing or empty is read by itself, as a host of one page.

Defined results: a null page counts as empty and has the empty text; a null or malformed address
belongs to the host ""; a host of fewer than ``EVIDENCE`` different pages has no template; blocks
nested deeper than ``DEPTH`` belong to their ancestor there; repeated rows give repeated results; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, materialize, releasing, small_batches, table_of
from tessera.llm.html_tree import BLOCK, Element, parse

#: Elements that never hold main text.
DROPPED = frozenset("script style noscript template nav aside footer form button select textarea input iframe object svg canvas dialog head title menu audio video".split())
#: Words in a class, id or role that mark what isn't main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended sidebar aside widget menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager masthead footer copyright comment comments disqus reply replies respond complementary contentinfo hidden skip toolbar".split()
)
REGION = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2"))
EVIDENCE, SHARE, MASS = 3, 0.5, 0.8
DEPTH = 512  # of nested blocks; as in browsers, deeper ones stand beside each other there
SMALL, HELD = 1 << 12, 1 << 22  # cells of the dynamic program: up to which lists beat arrays, and that are held at a time


def is_marked(element: Element) -> bool:
    """Whether the element's name, class, id or role says that it holds no main text."""
    if element.name in DROPPED:
        return True
    if not element.attrs or element.name in ("html", "body"):
        return False
    words = set(re.findall(r"[a-z]+", " ".join(element.attrs.get(k, "") for k in ("class", "id", "role")).lower()))
    return bool(words & ({"comment", "comments", "reply"} if element.name in REGION else MARKS))


def label(element: Element) -> str:
    """Name, classes, id and role; figures in them count as one, and separators of names are left out."""
    if not element.attrs or element.name in ("html", "body"):
        return element.name
    marks = " ".join(sorted(element.attrs.get("class", "").split())), element.attrs.get("id", ""), element.attrs.get("role", "")
    return re.sub(r"[./^]", "_", re.sub(r"\d+", "0", "|".join((element.name, *marks)))) if any(marks) else element.name


@dataclass(slots=True)
class Block:
    """A leaf's text, its first part if more follow an inline element, and what follows that."""

    text: str
    first: str
    rest: str
    linked: int


@dataclass(slots=True)
class Node:
    """A container, or a leaf (label ends in "=") with its repeated blocks."""

    label: str
    children: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    shape: int = -1  # its number in a Matcher

    def add(self, child: Node) -> None:
        last = self.children[-1] if self.children else None
        if child.blocks and last and last.label == child.label:
            last.blocks += child.blocks
        else:
            self.children.append(child)


def _collapsed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def outline(page: Element) -> Node:
    """A page's tree of blocks; nodes without text are left out.  Deep trees need no recursion."""
    root = Node("#root")
    open_ = [root]
    over = [0]  # blocks below DEPTH that are open within the last container
    parts: list[str] = []
    linked: list[bool] = []
    marks: list[int] = []  # where in ``parts`` inline elements start or end
    links = 0

    def flush() -> None:
        whole = _collapsed(parts)
        if whole:
            cut = next((m for m in marks if any(p.strip() for p in parts[:m]) and any(p.strip() for p in parts[m:])), 0)
            chars = min(len(whole), len(_collapsed([p for p, is_link in zip(parts, linked, strict=True) if is_link])) if any(linked) else 0)
            open_[-1].add(Node("#text=", [], [Block(whole, _collapsed(parts[:cut]), _collapsed(parts[cut:]) if cut else whole, chars)]))
        parts.clear()
        linked.clear()
        marks.clear()

    todo: list[tuple[str, Element | str]] = [("in", page)]
    while todo:
        step, node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
            linked.append(links > 0)
        elif step == "out":
            if node.name in BLOCK:
                flush()
                if over[-1]:
                    over[-1] -= 1
                    continue
                over.pop()
                done = open_.pop()
                if len(done.children) == 1 and done.children[0].label == "#text=":
                    leaf = done.children[0]
                    for b in leaf.blocks:
                        open_[-1].add(Node(done.label + "=", [], [b]))
                elif done.children:
                    open_[-1].add(done)
            else:
                links -= node.name == "a"
                marks.append(len(parts))
        elif node.name == "br":
            parts.append("\n")
            linked.append(False)
        elif node is page or not is_marked(node):
            if node is not page:
                if node.name in BLOCK:
                    flush()
                    if len(open_) > DEPTH:
                        over[-1] += 1
                    else:
                        open_.append(Node(label(node)))
                        over.append(0)
                else:
                    links += node.name == "a"
                    marks.append(len(parts))
                todo.append(("out", node))
            todo.extend(("in", c) for c in reversed(node.children))
    flush()
    return root


class Matcher:
    """Simple tree matching of two trees, each pair of shapes once.

    Nodes of equal labels whose children have equal shapes, in order, are of one shape.  Equal shapes match
    whole.  Children that two nodes' lists have in common at their start or end are matched with each
    other, which no other matching can better; what is left between goes through the dynamic program, a row
    at a time.
    """

    def __init__(self, a: Node, b: Node) -> None:
        self.ids: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}
        self.bounds: dict[tuple[int, int], int] = {}
        self.paths: dict[int, dict[int, int]] = {}
        self.path_ids: dict[tuple[str, int], int] = {}
        for tree in (a, b):
            order = [tree]
            for node in order:  # grows while it is read
                order += node.children
            for node in reversed(order):
                below = tuple([c.shape for c in node.children])
                node.shape = self.ids.setdefault((node.label, below), len(self.ids))
                if node.shape == len(self.labels):
                    self.labels.append(node.label)
                    self.children.append(below)
                    self.sizes.append(1 + sum([self.sizes[c] for c in below]))

    def weight(self, x: int, y: int) -> int:
        """Nodes in the largest matching of two shapes."""
        if x == y:
            return self.sizes[x]
        if self.labels[x] != self.labels[y]:
            return 0
        found = self.known.get((x, y))
        if found is None:
            xs, ys = self.children[x], self.children[y]
            start, end = _common(xs, ys)
            found = 1 + sum([self.sizes[c] for c in (*xs[:start], *xs[len(xs) - end :])])
            found += self._between(xs[start : len(xs) - end], ys[start : len(ys) - end])
            self.known[x, y] = found
        return found

    def _in_step(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> bool:
        """Whether the lists' labels are the same and all different, so that only equal places can match."""
        labels = [self.labels[x] for x in xs]
        return labels == [self.labels[y] for y in ys] and len(set(labels)) == len(labels)

    def _between(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
        if not xs or not ys:
            return 0
        if len(xs) == len(ys) and self._in_step(xs, ys):
            return sum([self.weight(x, y) for x, y in zip(xs, ys, strict=True)])
        if len(xs) * len(ys) > SMALL:  # below, arrays cost more than they save
            return int(deque(self._rows(xs, ys), 1)[0][-1])
        return self._lazily(xs, ys)[0]

    def _lazily(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        """Nodes and places of a largest matching of two lists, looking into as few pairs as may be."""
        table = [[self._bound(x, y) for y in ys] for x in xs]
        while True:  # until the best matching by what pairs can have at most is one of pairs that are known
            rows = [[0] * (len(ys) + 1)]
            for most in table:
                row, last, new = rows[-1], 0, [0]
                for j, w in enumerate(most):
                    best = row[j] + w
                    if row[j + 1] > best:
                        best = row[j + 1]
                    if best > last:
                        last = best
                    new.append(last)
                rows.append(new)
            i, j, sure, found = len(xs), len(ys), True, []
            while i and j:
                here = rows[i][j]
                if here == rows[i - 1][j]:
                    i -= 1
                elif here == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((i, j))
                    if (exact := self.weight(xs[i], ys[j])) != table[i][j]:
                        table[i][j], sure = exact, False
            if sure:
                return rows[-1][-1], found[::-1]

    def _bound(self, x: int, y: int) -> int:
        """At least the weight, and the weight itself once it is known: matched nodes stand below equal labels."""
        if x == y:
            return self.sizes[x]
        if self.labels[x] != self.labels[y]:
            return 0
        found = self.known.get((x, y))
        if found is None:
            found = self.bounds.get((x, y))
            if found is None:
                a, b = self._paths(x), self._paths(y)
                if len(a) > len(b):
                    a, b = b, a
                found = self.bounds[x, y] = sum([min(n, b[p]) for p, n in a.items() if p in b])
        return found

    def _paths(self, x: int) -> dict[int, int]:
        """How many nodes of a shape stand below which labels, by number."""
        found = self.paths.get(x)
        if found is None:
            of = self.path_ids
            found = defaultdict(int)
            own = self.labels[x]
            found[of.setdefault((own, -1), len(of))] = 1
            for c in self.children[x]:
                for p, n in self._paths(c).items():
                    found[of.setdefault((own, p), len(of))] += n
            self.paths[x] = found
        return found

    def _rows(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> Iterator[np.ndarray]:
        """For each start of ``xs``, the most nodes that it and each start of ``ys`` can match."""
        kinds = list(dict.fromkeys(ys))
        at = {y: i for i, y in enumerate(kinds)}
        where = np.array([at[y] for y in ys])
        weights: dict[int, np.ndarray] = {}
        row = np.zeros(len(ys) + 1, np.int64)
        for x in xs:
            if x not in weights:
                weights[x] = np.array([self.weight(x, y) for y in kinds])
            row = row.copy()
            np.maximum(row[1:], row[:-1] + weights[x][where], out=row[1:])
            np.maximum.accumulate(row, out=row)
            yield row

    def pairs(self, x: int, y: int) -> list[tuple[int, int]]:
        """Places of the children that a largest matching of two shapes pairs."""
        xs, ys = self.children[x], self.children[y]
        start, end = _common(xs, ys)
        between = self._pairs(xs[start : len(xs) - end], ys[start : len(ys) - end])
        return [*((i, i) for i in range(start)), *((start + i, start + j) for i, j in between), *((len(xs) - k, len(ys) - k) for k in range(end, 0, -1))]

    def _pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        if not xs or not ys:
            return []
        if len(xs) == len(ys) and self._in_step(xs, ys):
            return [(i, i) for i in range(len(xs))]
        if len(xs) * len(ys) <= SMALL:
            return self._lazily(xs, ys)[1]
        if len(xs) > 1 and len(xs) * len(ys) > HELD:  # halve the left side, and the right one where both halves match most
            half = len(xs) // 2
            before, after = (deque(self._rows(*lists), 1)[0] for lists in ((xs[:half], ys), (xs[half:][::-1], ys[::-1])))
            cut = int(np.argmax(before + after[::-1]))
            return [*self._pairs(xs[:half], ys[:cut]), *((half + i, cut + j) for i, j in self._pairs(xs[half:], ys[cut:]))]
        rows = [np.zeros(len(ys) + 1, np.int64), *self._rows(xs, ys)]
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]


def _common(xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int]:
    """How many first and how many last members two lists have in common."""
    least = min(len(xs), len(ys))
    start = next((i for i in range(least) if xs[i] != ys[i]), least)
    end = next((i for i in range(least - start) if xs[-1 - i] != ys[-1 - i]), least - start)
    return start, end


def matching(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest simple tree matching and the matched pairs among the roots' children."""
    both = Matcher(a, b)
    return both.weight(a.shape, b.shape), both.pairs(a.shape, b.shape) if a.label == b.label else []


def named(seed: Node | None, page: Node) -> Iterator[tuple[str, Node]]:
    """(name, node) of all nodes of a page in page order, as its alignment with the seed names them."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEPTH))
    both = Matcher(seed, page) if seed else None
    todo: list[tuple[str, Node, Node | None]] = [("0", page, seed if seed and seed.label == page.label else None)]
    while todo:
        name, node, twin = todo.pop()
        yield name, node
        if not node.children:
            continue
        if twin is None:
            todo += [(f"{name}/{c.label}", c, None) for c in reversed(node.children)]
            continue
        partner = {j: i for i, j in both.pairs(twin.shape, node.shape)} if twin.shape != node.shape else None
        for j in range(len(node.children) - 1, -1, -1):
            child, i = node.children[j], j if partner is None else partner.get(j)
            todo.append((f"{name}/{child.label}", child, None) if i is None else (f"{name}.{i}", child, twin.children[i]))


def above(name: str) -> str:
    """The name of a node's parent; "" for the root."""
    return name[: max(name.rfind("."), name.rfind("/"), 0)]


def text_hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass(slots=True)
class Seen:
    """What pages show at the names of their nodes: sums that can be added in any order."""

    nodes: dict[str, list] = field(default_factory=dict)  # name -> [label, pages, characters that aren't linked]
    texts: dict[tuple[str, int], list] = field(default_factory=dict)  # (name, text) -> [pages, such characters, bits of pages]

    def add(self, page_hash: int, nodes: list[tuple[str, Node]]) -> None:
        mass: dict[str, int] = defaultdict(int)
        labels: dict[str, str] = {}
        shown: dict[tuple[str, int], int] = defaultdict(int)
        inside: dict[str, bool] = {"": False}  # below an article or main element
        counts: dict[str, bool] = {"": True}  # what stands in a header outside of those has no weight
        for name, node in nodes:
            of, parent = node.label.partition("|")[0], above(name)
            labels[name] = node.label
            mass[name] += 0
            inside[name] = inside[parent] or of in REGION
            counts[name] = counts[parent] and (inside[name] or of != "header")
            for b in node.blocks:
                own = len(b.text) - b.linked if counts[name] else 0
                mass[name] += own
                shown[name, text_hash(b.text)] += own
                if b.first:
                    labels[name + "^"] = node.label
                    shown[name + "^", text_hash(b.first)] += min(own, len(b.first))
        for name in reversed(inside):  # parents come before their children
            if name and (parent := above(name)):
                mass[parent] += mass[name]
        for name, of in labels.items():
            entry = self.nodes.setdefault(name, [of, 0, 0])
            entry[1] += 1
            entry[2] += mass[name]
        bit = 1 << (page_hash & 127)
        for key, own in shown.items():
            entry = self.texts.setdefault(key, [0, 0, 0])
            entry[0] += 1
            entry[1] += own
            entry[2] |= bit

    def constants(self) -> dict[str, set[int]]:
        """The template's texts by name."""
        found: dict[str, set[int]] = defaultdict(set)
        for (name, text), (n, _, bits) in self.texts.items():
            if bits.bit_count() >= EVIDENCE and n >= SHARE * self.nodes[name][1]:
                found[name].add(text)
        return found

    def wrapper(self) -> Wrapper:
        template = self.constants()
        mass = {name: own for name, (_, _, own) in self.nodes.items()}
        for name, texts in template.items():
            if not name.endswith("^"):
                gone = sum(self.texts[name, t][1] for t in texts)
                while name:
                    if name in mass:
                        mass[name] -= gone
                    name = above(name)
        region = region_of({name: (of, n, mass[name]) for name, (of, n, _) in self.nodes.items()})
        return Wrapper(region, {n: t for n, t in template.items() if n == region or n.startswith((region + ".", region + "/", region + "^"))})


def region_of(nodes: dict[str, tuple[str, int, int]]) -> str:
    """The name of the article's region; ``nodes``: name -> (label, pages, varying characters that aren't linked)."""
    children: dict[str, list[str]] = defaultdict(list)
    for name in nodes:
        if name != "0" and not name.endswith("^"):
            children[above(name)].append(name)

    def element(name: str) -> str:
        return nodes[name][0].partition("|")[0].rstrip("=")

    total, here = nodes["0"][2] if "0" in nodes else 0, "0"
    while here in nodes and element(here) != "article":
        below = [c for c in children[here] if not nodes[c][0].endswith("=") and element(c) != "header"]
        best = max(below, key=lambda c: (nodes[c][2], c), default=None)
        if best is None or nodes[best][2] < MASS * total or (element(here) == "main" and element(best) != "article"):
            break
        headed = any(element(c) in HEADINGS and nodes[c][0].endswith("=") and nodes[c][1] >= SHARE * nodes[here][1] for c in children[here])
        if headed and element(best) not in REGION:
            break
        here = best
    return here


@dataclass(slots=True)
class Wrapper:
    """A host's region and the template's texts within it, by name."""

    region: str
    template: dict[str, set[int]]

    def dump(self) -> bytes:
        return zlib.compress(json.dumps([self.region, sorted((n, sorted(t)) for n, t in self.template.items())]).encode())

    @staticmethod
    def load(data: bytes) -> Wrapper:
        region, template = json.loads(zlib.decompress(data))
        return Wrapper(region, {n: set(t) for n, t in template})

    def read(self, nodes: list[tuple[str, Node]]) -> str:
        region, below, out = self.region, (self.region + ".", self.region + "/"), []
        for name, node in nodes:
            if node.blocks and (name == region or name.startswith(below)):
                whole, part = self.template.get(name, ()), self.template.get(name + "^", ())
                for b in node.blocks:
                    if not whole or text_hash(b.text) not in whole:
                        out.append(b.rest if part and b.first and text_hash(b.first) in part else b.text)
        return "\n\n".join(out)


def seed_tree(source: str | None) -> Node | None:
    return None if source is None else outline(parse(source))


def extract(source: str, seed: Node | None, wrapper: Wrapper | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = outline(parse(source))
    text = wrapper.read(list(named(seed, page))) if wrapper else ""
    if text:
        return text
    alone, own = Seen(), list(named(None, page))
    alone.add(0, own)
    return alone.wrapper().read(own)


HOST = r"^(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
STRUCTURE = r"(?i)<(html|body|main|article|section|div|header|footer|nav|aside|form|table|ul|ol|h1|h2)\b"
SEEN = "host string, node string, label string, text long, n long, mass long, low long, high long"
WRAPPERS = "host string, wrapper binary"
TEXTS = "page_id long, url string, text string, n_chars long"


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def seeds(pages: DataFrame, most_hosts: int = 200_000) -> DataFrame:
    """host, seed: the page that each host's pages are aligned with."""
    used = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(STRUCTURE), 1), F.lower))), " ")
    rows = pages.select("host", used.alias("used"), F.xxhash64("html").alias("key"))
    kinds = rows.groupBy("host", "used").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    chosen = materialize(kinds.groupBy("host").agg(F.max_by("key", F.struct("n", "used")).alias("key")), "wrapper-seeds")
    small = chosen.count() <= most_hosts
    keyed = pages.select("host", "html", F.xxhash64("html").alias("key")).join(F.broadcast(chosen) if small else chosen, ["host", "key"])
    return keyed.groupBy("host").agg(F.min("html").alias("seed"))


class Known:
    """What the pages of ``rows`` need of their hosts: broadcast up to ``most_bytes``, else joined to them."""

    def __init__(self, rows: DataFrame, table: DataFrame, columns: list[str], most_bytes: int) -> None:
        size = table.agg(F.coalesce(F.sum(F.octet_length("host") + sum(F.octet_length(c) for c in columns)), F.lit(0))).first()[0]
        self.columns, self.shared, self.rows = columns, None, rows
        if size <= most_bytes:
            self.shared = rows.sparkSession.sparkContext.broadcast({r["host"]: tuple(r[c] for c in columns) for r in table.collect()})
        else:
            self.rows = rows.join(table, "host", "left")

    def of(self):
        """A function from a batch to the columns' values of each row."""
        columns, shared = self.columns, self.shared

        def values(batch: pa.RecordBatch) -> list[tuple]:
            if shared is None:
                return list(zip(*(batch[c].to_pylist() for c in columns), strict=True))
            return [shared.value.get(h, (None,) * len(columns)) for h in batch["host"].to_pylist()]

        return values


def _kept(cache: dict, host: str, make):
    if host not in cache:
        if len(cache) >= 500:
            cache.clear()
        cache[host] = make()
    return cache[host]


def seen(pages: DataFrame, table: DataFrame, most_bytes: int, most: int = 200_000) -> DataFrame:
    """host, node, label, text, n, mass, low, high: what all pages show; ``text`` is null for the node itself."""
    known = Known(pages.select("host", "html"), table, ["seed"], most_bytes)
    seed_of = known.of()

    def signed(bits: int) -> int:
        return bits - (1 << 64) if bits >> 63 else bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Seen] = defaultdict(Seen)
        trees: dict[str, Node] = {}

        def sent() -> pa.RecordBatch:
            rows = [(host, name, of, None, n, own, 0, 0) for host, s in hosts.items() for name, (of, n, own) in s.nodes.items()]
            rows += [(host, name, None, text, n, own, signed(bits & (1 << 64) - 1), signed(bits >> 64)) for host, s in hosts.items() for (name, text), (n, own, bits) in s.texts.items()]
            return table_of(SEEN, rows).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if rows else None

        size = 0
        for batch in batches:
            for host, (source,), html in zip(batch["host"].to_pylist(), seed_of(batch), batch["html"].to_pylist(), strict=True):
                seed = _kept(trees, host, lambda source=source: seed_tree(source))
                of = hosts[host]
                size -= len(of.nodes) + len(of.texts)
                of.add(text_hash(html), list(named(seed, outline(parse(html)))))
                size += len(of.nodes) + len(of.texts)
                if size > most:
                    yield sent()
                    hosts.clear()
                    size = 0
        if hosts:
            yield sent()

    return known.rows.mapInArrow(releasing(run), SEEN)


def _decide(key: tuple, table: pa.Table) -> pa.Table:
    """A host's wrapper from its nodes and the texts that may be template."""
    found = Seen()
    for r in table.to_pylist():
        if r["text"] is None:
            found.nodes[r["node"]] = [r["label"], r["n"], r["mass"]]
        else:
            found.texts[r["node"], r["text"]] = [r["n"], r["mass"], (r["low"] & (1 << 64) - 1) | (r["high"] & (1 << 64) - 1) << 64]
    return table_of(WRAPPERS, [(key[0].as_py(), found.wrapper().dump())])


def induce(pages: DataFrame, table: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """host, wrapper: over all pages (host, html) of each host; ``table``: what ``seeds`` gives.

    Of nodes, those on a twentieth of a host's pages or more go into a decision, and the texts that
    half of a node's pages show; so a host's rows there are bounded by what its pages hold on average.
    """
    summed = seen(pages, table, most_bytes).groupBy("host", "node", "text").agg(
        F.max("label").alias("label"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high")
    )
    evidence = F.bit_count("low") + F.bit_count("high") >= EVIDENCE
    counts = materialize(summed.where(F.col("text").isNull() | evidence), "wrapper-counts")
    nodes = counts.where(F.col("text").isNull())
    whole = nodes.where("node = '0'").select("host", F.col("n").alias("_of"))
    often = nodes.join(whole, "host").where(F.col("n") * 20 >= F.col("_of")).drop("_of")
    shown = often.select("host", "node", F.col("n").alias("_of"))
    constant = counts.where(F.col("text").isNotNull()).join(shown, ["host", "node"]).where(F.col("n") >= SHARE * F.col("_of")).drop("_of")
    return often.unionByName(constant).groupBy("host").applyInArrow(releasing(_decide), WRAPPERS)


def main_texts(pages: DataFrame, most_bytes: int = 16 << 20, induced: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of ``pages``; without ``induced`` every page is read by itself."""
    small_batches(pages.sparkSession)
    rows, schema = _pages(pages), arrow_schema(TEXTS)
    table = materialize(seeds(rows) if induced else rows.select("host", F.col("html").alias("seed")).limit(0), "wrapper-seeds")
    wrappers = induce(rows, table, most_bytes) if induced else table.select("host", F.col("seed").cast("binary").alias("wrapper"))
    known = Known(rows, materialize(table.join(wrappers, "host"), "wrappers"), ["seed", "wrapper"], most_bytes)
    parts_of = known.of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple[Node | None, Wrapper | None]] = {}
        for batch in batches:
            texts = []
            for host, (source, data), html in zip(batch["host"].to_pylist(), parts_of(batch), batch["html"].to_pylist(), strict=True):
                seed, wrapper = _kept(ready, host, lambda source=source, data=data: (seed_tree(source), data and Wrapper.load(bytes(data))))
                texts.append(extract(html, seed, wrapper))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return known.rows.mapInArrow(releasing(run), TEXTS)
