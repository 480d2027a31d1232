"""A small sandboxed template language compiled to Python closures.

    text            copied
    {{ e | f }}     the value of an expression, through filters
    {% for x in e %} ... {% endfor %}       loop.first, loop.last, loop.index inside
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set x = e %}
    {% generation %} ... {% endgeneration %}   what is rendered inside is under the loss mask

Expressions: strings, integers, true, false, names, ``a.b`` on mappings, ``== !=``,
``and or not``, ``+`` (a sum of integers, else texts joined), parentheses. There are no calls, subscripts, imports or Python
attributes, so a template can read only what it is given. The source is parsed to a syntax
tree, constants are folded (also constant branches and neighbouring literals), and each node
becomes a closure ``f(env) -> iterator of (text, under_loss)``; loops take any iterable and
render lazily, so a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+().|]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.toks, at, text = [], 0, text.strip()
        while at < len(text):
            if not (m := _TOKENS.match(text, at)):
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.toks) and self.toks[self.at][1] in values and self.toks[self.at][0] != "str":
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def whole(self) -> Any:
        out = self.either()
        while self.take("|"):
            out = Filter(out, self.word())
        if self.at != len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.at][1]!r}")
        return out

    def word(self) -> str:
        if self.at >= len(self.toks) or self.toks[self.at][0] != "name":
            raise TemplateError("a name is expected")
        self.at += 1
        return self.toks[self.at - 1][1]

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.summed()
        while op := self.take("==", "!="):
            out = Op(op, (out, self.summed()))
        return out

    def summed(self) -> Any:
        out = self.atom()
        while self.take("+"):
            out = Op("+", (out, self.atom()))
        return out

    def atom(self) -> Any:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is open")
        elif self.at < len(self.toks) and self.toks[self.at][0] == "str":
            self.at += 1
            out = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), self.toks[self.at - 1][1][1:-1], flags=re.S))
        elif self.at < len(self.toks) and self.toks[self.at][0] == "int":
            self.at += 1
            out = Const(int(self.toks[self.at - 1][1]))
        else:
            name = self.word()
            out = Const(name == "true") if name in ("true", "false") else Name(name)
        while self.take("."):
            out = Field(out, self.word())
        return out


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    steps, at = [], 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            steps.append(("text", source[at : m.start()]))
        steps.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        steps.append(("text", source[at:]))
    for kind, text in steps:
        if kind == "text" and ("{{" in text or "{%" in text):
            raise TemplateError(f"a tag is not closed: {text[text.index('{') :][:40]!r}")
    pos = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        nodes: list[Any] = []
        while pos < len(steps):
            kind, text = steps[pos]
            pos += 1
            if kind == "text":
                nodes.append(Out(Const(text)))
            elif kind == "out":
                nodes.append(Out(_Expression(text).whole()))
            elif text.split(None, 1)[0:1] and text.split(None, 1)[0] in ends:
                return tuple(nodes), text
            elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", text, re.S):
                inner, _ = body("endfor")
                nodes.append(For(m[1], _Expression(m[2]).whole(), inner))
            elif m := re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)", text, re.S):
                nodes.append(Set(m[1], _Expression(m[2]).whole()))
            elif text == "generation":
                inner, _ = body("endgeneration")
                nodes.append(Generation(inner))
            elif m := re.fullmatch(r"if\s+(.+)", text, re.S):
                branches, condition = [], _Expression(m[1]).whole()
                while True:
                    inner, end = body("elif", "else", "endif")
                    branches.append((condition, inner))
                    if end == "endif":
                        break
                    condition = Const(True) if end == "else" else _Expression(end[4:]).whole()
                nodes.append(If(tuple(branches)))
            else:
                raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    return body()[0]


def _plus(a: Any, b: Any) -> Any:
    """The sum of two integers, else the texts of both joined; null has none."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    return a + b if whole(a) and whole(b) else _text(a) + _text(b)


_OPS: dict[str, Callable[..., Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: _plus(a, b), "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(node: Any, filters: Mapping[str, Callable[[str], str]]) -> Any:
    """The tree with constant expressions and branches evaluated and literals joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        todo = [fold(n, filters) for n in node][::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x[::-1])
            elif isinstance(x, Out) and isinstance(x.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(_text(out[-1].value.value) + _text(x.value.value)))
            else:
                out.append(x)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Field):
        return Field(fold(node.of, filters), node.name)
    if isinstance(node, Out):
        return Out(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        kept = []
        for condition, inner in node.branches:
            condition, inner = fold(condition, filters), fold(inner, filters)
            if isinstance(condition, Const) and not condition.value:
                continue
            if isinstance(condition, Const) and not kept:
                return inner
            kept.append((condition, inner))
            if isinstance(condition, Const):
                break
        return If(tuple(kept)) if kept else ()
    return node


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


Env = dict[str, Any]
Segments = Iterator[tuple[str, bool]]


def _value(node: Any, filters: Mapping[str, Callable[[str], str]]) -> Callable[[Env], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Field):
        of = _value(node.of, filters)
        return lambda env, n=node.name: (x.get(n) if isinstance(x := of(env), Mapping) else None)
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(_text(of(env)))
    args = [_value(a, filters) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    op = _OPS[node.op]
    return lambda env: op(*(a(env) for a in args))


def _body(nodes: tuple, filters: Mapping[str, Callable[[str], str]], loss: bool) -> Callable[[Env], Segments]:
    parts = [_node(n, filters, loss) for n in nodes]

    def run(env: Env) -> Segments:
        for part in parts:
            yield from part(env)

    return run


def _node(node: Any, filters: Mapping[str, Callable[[str], str]], loss: bool) -> Callable[[Env], Segments]:
    if isinstance(node, Out):
        value = _value(node.value, filters)
        return lambda env: iter([(_text(value(env)), loss)])
    if isinstance(node, Set):
        value, name = _value(node.value, filters), node.name

        def assign(env: Env) -> Segments:
            env[name] = value(env)
            return iter(())

        return assign
    if isinstance(node, Generation):
        return _body(node.body, filters, True)
    if isinstance(node, If):
        branches = [(_value(c, filters), _body(b, filters, loss)) for c, b in node.branches]

        def choose(env: Env) -> Segments:
            for condition, body in branches:
                if condition(env):
                    return body(env)
            return iter(())

        return choose
    over, body, name = _value(node.over, filters), _body(node.body, filters, loss), node.name

    def loop(env: Env) -> Segments:
        items = iter(over(env) or ())
        item, n = next(items, _END), 0
        while item is not _END:
            after = next(items, _END)
            inner = env | {name: item, "loop": {"index": n + 1, "first": n == 0, "last": after is _END}}
            yield from body(inner)
            item, n = after, n + 1

    return loop


_END = object()


@dataclass(frozen=True)
class Template:
    """A compiled template; calling it with variables yields (text, under_loss) segments."""

    source: str
    filters: Mapping[str, Callable[[str], str]] = field(default_factory=dict)

    def compiled(self) -> Callable[..., Segments]:
        run = _body(fold(parse(self.source), self.filters), self.filters, False)
        return lambda **variables: run(dict(variables))


def render(template: Template, **variables: Iterable) -> str:
    return "".join(text for text, _ in template.compiled()(**variables))
