"""A small sandboxed template language, compiled to Python closures.

Text with ``{{ expression }}`` and ``{% statement %}``.  Statements: ``for x in expression`` /
``endfor`` (with ``loop.index``, ``loop.index0``, ``loop.first``), ``if`` / ``elif`` / ``else`` /
``endif``, ``set x = expression``, and ``generation`` / ``endgeneration``, which marks output that a
model is trained on.  Expressions: literals, names, ``a.b`` and ``a['b']`` on mappings and lists,
``not and or``, ``== != < <= > >= in``, ``+ - * ~``, ``a if c else b``, parentheses and
``value | filter(arguments)``.

The source is parsed into a syntax tree, the tree is folded (operations on constants, branches
with constant conditions, adjacent texts), and each node becomes a closure.  Templates reach
nothing but the values and filters they are given: no attributes of Python objects, no calls.

A rendered template is a stream of (text, is_generation) parts, so a loop over a lazy sequence
renders in the memory of one item.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template is malformed or reaches outside its sandbox."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class If:
    test: Any
    yes: Block
    no: Block


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: Block


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: Block


TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.DOTALL)
TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*~|().,\[\]<>=]))""")
ESCAPES = {"n": "\n", "t": "\t"}
LITERALS = {"true": True, "false": False, "none": None}
BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "~": lambda a, b: _text(a) + _text(b), "in": lambda a, b: a in b,
}
FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda s: _text(s).strip(),
    "upper": lambda s: _text(s).upper(),
    "lower": lambda s: _text(s).lower(),
    "length": len,
    "replace": lambda s, a, b: _text(s).replace(a, b),
    "default": lambda v, d: d if v is None else v,
    "join": lambda v, by="": by.join(map(_text, v)),
}


def _text(value: Any) -> str:
    return "" if value is None else str(value)


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return value if kind in ("op", "name") else ""

    def take(self, *wanted: str) -> str:
        if (now := self.peek()) and now in wanted:
            self.at += 1
            return now
        return ""

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def word(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"name expected, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Any:
        yes = self.either()
        if not self.take("if"):
            return yes
        test = self.either()
        self.need("else")
        return Choice(test, yes, self.choice())

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self) -> Any:
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = Binary(op, node, self.joined())
        return node

    def joined(self) -> Any:
        node = self.summed()
        while self.take("~"):
            node = Binary("~", node, self.summed())
        return node

    def summed(self) -> Any:
        node = self.factor()
        while op := self.take("+", "-"):
            node = Binary(op, node, self.factor())
        return node

    def factor(self) -> Any:
        node = self.filtered()
        while self.take("*"):
            node = Binary("*", node, self.filtered())
        return node

    def filtered(self) -> Any:
        node = self.atom()
        while True:
            if self.take("."):
                node = Item(node, Const(self.word()))
            elif self.take("["):
                node = Item(node, self.choice())
                self.need("]")
            elif self.take("|"):
                node = Filter(self.word(), (node, *self.arguments()))
            else:
                return node

    def arguments(self) -> list[Any]:
        found: list[Any] = []
        if self.take("(") and not self.take(")"):
            found.append(self.choice())
            while self.take(","):
                found.append(self.choice())
            self.need(")")
        return found

    def atom(self) -> Any:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "num":
            self.at += 1
            return Const(int(value))
        word = self.word()
        return Const(LITERALS[word]) if word in LITERALS else Name(word)


@dataclass
class _Parser:
    parts: list[str]
    at: int = 0
    ended: str = ""
    rest: str = field(default="", repr=False)

    def block(self, *ends: str) -> Block:
        """Up to a statement whose first word is in ``ends``; it is left in ``ended`` and ``rest``."""
        found: list[Any] = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{") and part.endswith("}}"):
                found.append(Output(_Expression(part[2:-2].strip("-")).whole()))
            elif part.startswith("{%") and part.endswith("%}"):
                word, _, rest = part[2:-2].strip("-").strip().partition(" ")
                if word in ends:
                    self.ended, self.rest = word, rest
                    return Block(tuple(found))
                found.append(self.statement(word, rest))
            elif part:
                found.append(Output(Const(part)))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Block(tuple(found))

    def statement(self, word: str, rest: str) -> Any:
        if word == "if":
            return self.condition(rest)
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.DOTALL)
            if not found:
                raise TemplateError(f"malformed loop {rest!r}")
            return For(found[1], _Expression(found[2]).whole(), self.block("endfor"))
        if word == "set":
            found = re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(.*)", rest, re.DOTALL)
            if not found:
                raise TemplateError(f"malformed assignment {rest!r}")
            return Set(found[1], _Expression(found[2]).whole())
        if word == "generation":
            return Generation(self.block("endgeneration"))
        raise TemplateError(f"unknown statement {word!r}")

    def condition(self, test: str) -> If:
        yes = self.block("elif", "else", "endif")
        no = Block(())
        if self.ended == "elif":
            no = Block((self.condition(self.rest),))
        elif self.ended == "else":
            no = self.block("endif")
        return If(_Expression(test).whole(), yes, no)


def parse(source: str) -> Block:
    """The syntax tree.  A ``-`` inside a tag strips the white space on that side."""
    parts = TAG.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    return _Parser(parts).block()


def fold(node: Any, filters: Mapping[str, Callable] = FILTERS) -> Any:
    """The same tree with constant parts computed."""
    again = lambda x: fold(x, filters)
    match node:
        case Item(of, key):
            node = Item(again(of), again(key))
            known = isinstance(node.of, Const) and isinstance(node.key, Const)
        case Unary(op, of):
            node = Unary(op, again(of))
            known = isinstance(node.of, Const)
        case Binary(op, left, right):
            node = Binary(op, again(left), again(right))
            known = isinstance(node.left, Const) and isinstance(node.right, Const)
        case Choice(test, yes, no):
            node = Choice(again(test), again(yes), again(no))
            if isinstance(node.test, Const):
                return node.yes if node.test.value else node.no
            known = False
        case Filter(name, args):
            if name not in filters:
                raise TemplateError(f"unknown filter {name!r}")
            node = Filter(name, tuple(map(again, args)))
            known = all(isinstance(a, Const) for a in node.args)
        case Output(of):
            of = again(of)
            return Output(Const(_text(of.value)) if isinstance(of, Const) else of)
        case Block(parts):
            flat: list[Any] = []
            for part in map(again, parts):
                for p in part.parts if isinstance(part, Block) else (part,):
                    if flat and all(isinstance(x, Output) and isinstance(x.of, Const) for x in (flat[-1], p)):
                        flat[-1] = Output(Const(flat[-1].of.value + p.of.value))
                    elif not (isinstance(p, Output) and p.of == Const("")):
                        flat.append(p)
            return Block(tuple(flat))
        case If(test, yes, no):
            test, yes, no = again(test), again(yes), again(no)
            return (yes if test.value else no) if isinstance(test, Const) else If(test, yes, no)
        case For(name, over, body):
            return For(name, again(over), again(body))
        case Set(name, value):
            return Set(name, again(value))
        case Generation(body):
            return Generation(again(body))
        case _:
            return node
    if not known:
        return node
    try:
        return Const(_value(node, filters)({}))
    except (TypeError, KeyError, IndexError):
        return node  # it fails when it is rendered, if it is


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    of = lambda x: _value(x, filters)
    match node:
        case Const(value):
            return lambda scope: value
        case Name(name):
            return lambda scope: scope.get(name)
        case Item(owner, key):
            owner, key = of(owner), of(key)

            def item(scope: dict) -> Any:
                value, k = owner(scope), key(scope)
                if isinstance(value, Mapping):
                    return value.get(k)
                if isinstance(value, (Sequence, str)) and isinstance(k, int):
                    return value[k]
                return None

            return item
        case Unary(_, inner):
            inner = of(inner)
            return lambda scope: not inner(scope)
        case Binary("and", left, right):
            left, right = of(left), of(right)
            return lambda scope: left(scope) and right(scope)
        case Binary("or", left, right):
            left, right = of(left), of(right)
            return lambda scope: left(scope) or right(scope)
        case Binary(op, left, right):
            left, right, fn = of(left), of(right), BINARY[op]
            return lambda scope: fn(left(scope), right(scope))
        case Choice(test, yes, no):
            test, yes, no = of(test), of(yes), of(no)
            return lambda scope: yes(scope) if test(scope) else no(scope)
        case Filter(name, args):
            args, fn = [of(a) for a in args], filters[name]
            return lambda scope: fn(*[a(scope) for a in args])
    raise TemplateError(f"{type(node).__name__} is no expression")


Parts = Iterator[tuple[str, bool]]


def _emit(node: Any, filters: Mapping[str, Callable], masked: bool) -> Callable[[dict], Parts]:
    match node:
        case Output(of):
            value = _value(of, filters)

            def output(scope: dict) -> Parts:
                yield _text(value(scope)), masked

            return output
        case Block(parts):
            emits = [_emit(p, filters, masked) for p in parts]

            def block(scope: dict) -> Parts:
                for emit in emits:
                    yield from emit(scope)

            return block
        case If(test, yes, no):
            test, yes, no = _value(test, filters), _emit(yes, filters, masked), _emit(no, filters, masked)
            return lambda scope: yes(scope) if test(scope) else no(scope)
        case For(name, over, body):
            over, body = _value(over, filters), _emit(body, filters, masked)

            def loop(scope: dict) -> Parts:
                for i, value in enumerate(over(scope) or ()):
                    yield from body(scope | {name: value, "loop": {"index": i + 1, "index0": i, "first": i == 0}})

            return loop
        case Set(name, value):
            value = _value(value, filters)

            def put(scope: dict) -> Parts:
                scope[name] = value(scope)
                return iter(())

            return put
        case Generation(body):
            return _emit(body, filters, True)
    raise TemplateError(f"{type(node).__name__} is no statement")


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], Parts]:
    """A renderer from variables to (text, is_generation) parts."""
    known = {**FILTERS, **(filters or {})}
    return lambda variables, emit=_emit(fold(parse(source), known), known, False): emit(dict(variables))
