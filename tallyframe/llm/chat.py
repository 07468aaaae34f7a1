"""Chat formatting: a small sandboxed template language, compiled to Python closures.

Grammar:  text, {{ expression }}, {% for x in messages %} ... {% endfor %},
{% if expression %} ... {% elif e %} ... {% else %} ... {% endif %},
{% generation %} ... {% endgeneration %}, {# comment #}.
Expressions: strings, integers, names, x.role and x.text, loop.first / loop.last / loop.index,
+ (concatenation), == != and or not, parentheses, and the filters trim, upper, lower, escape.
There is no attribute access beyond those fields, no call and no import, so a template can do nothing else.

A template becomes a syntax tree; constant parts are folded; each node becomes a closure that yields
(text, is_generation) pieces.  The loop over messages reads an iterator with one message of
lookahead, so a conversation of any length is rendered as it streams by.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_][A-Za-z_0-9]*)|(==|!=|[+|.()]))""")
_FIELDS = {"role", "text", "first", "last", "index"}
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


class TemplateError(ValueError):
    """The template is outside the language."""


def escape(text: str) -> str:
    """Break up control strings with a backslash and double backslashes, so that no control string is left and `unescape` undoes it."""
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


_FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape}


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None = None


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Out:
    expr: object


@dataclass(frozen=True)
class For:
    var: str
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition or None, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expressions:
    """Recursive descent: or, and, not, comparison, +, filters, atoms."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"at {source[at:at + 20]!r}")
            text, number, name, sign = m.groups()
            self.tokens.append(("text", re.sub(r"\\(.)", lambda k: {"n": "\n", "t": "\t"}.get(k[1], k[1]), text[1:-1])) if text is not None else ("number", int(number)) if number else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def _take(self, *wanted: tuple) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return True
        return False

    def whole(self):
        out = self._either()
        if self.at != len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at:]}")
        return out

    def _either(self):
        out = self._both()
        while self._take(("name", "or")):
            out = fold(Op("or", (out, self._both())))
        return out

    def _both(self):
        out = self._negated()
        while self._take(("name", "and")):
            out = fold(Op("and", (out, self._negated())))
        return out

    def _negated(self):
        return fold(Op("not", (self._negated(),))) if self._take(("name", "not")) else self._compared()

    def _compared(self):
        out = self._joined()
        for sign in ("==", "!="):
            if self._take(("sign", sign)):
                return fold(Op(sign, (out, self._joined())))
        return out

    def _joined(self):
        out = self._filtered()
        while self._take(("sign", "+")):
            out = fold(Op("+", (out, self._filtered())))
        return out

    def _filtered(self):
        out = self._atom()
        while self._take(("sign", "|")):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
            if kind != "name" or name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = fold(Op(name, (out,)))
        return out

    def _atom(self):
        if self._take(("sign", "(")):
            out = self._either()
            if not self._take(("sign", ")")):
                raise TemplateError("missing )")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("text", "number"):
            return Const(value)
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if self._take(("sign", ".")):
            kind, field = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
            if kind != "name" or field not in _FIELDS:
                raise TemplateError(f"no field {field!r}")
            self.at += 1
            return Name(value, field)
        return Name(value)


_PURE: dict[str, Callable] = {"+": lambda a, b: f"{a}{b}", "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b}
_PURE |= {name: (lambda f: lambda a: f(str(a)))(f) for name, f in _FILTERS.items()}


def fold(node):
    """An operation on constants is a constant."""
    if isinstance(node, Op) and all(isinstance(a, Const) for a in node.args):
        return Const(_PURE[node.kind](*(a.value for a in node.args)))
    return node


def parse(source: str) -> tuple:
    """The syntax tree of a template, constants folded and neighbouring texts joined."""
    parts = [p for p in _PARTS.split(source) if p and not p.startswith("{#")]
    body, at, end = _body(parts, 0, ())
    if end:
        raise TemplateError(f"unexpected {end!r}")
    return body


def _body(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str]:
    out: list = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if part.startswith("{{"):
            out.append(Out(_Expressions(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word in ends:
                return _joined_texts(out), at, word + " " + rest.strip()
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
                if not m:
                    raise TemplateError(f"for {rest!r}")
                body, at, end = _body(parts, at, ("endfor",))
                out.append(For(m[1], body))
            elif word == "if":
                branches, condition, end = [], _Expressions(rest).whole(), ""
                while True:
                    body, at, end = _body(parts, at, ("elif", "else", "endif"))
                    branches.append((condition, body))
                    if end.startswith("elif"):
                        condition = _Expressions(end[4:]).whole()
                    elif end.startswith("else"):
                        condition = None
                    else:
                        break
                out += _live(branches)
            elif word == "generation":
                body, at, end = _body(parts, at, ("endgeneration",))
                out.append(Generation(body))
            else:
                raise TemplateError(f"unexpected {word!r}")
        else:
            out.append(Out(Const(part)))
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return _joined_texts(out), at, ""


def _live(branches: list) -> list:
    """Drop branches whose condition is constantly false; what follows a constantly true one never runs."""
    kept = []
    for condition, body in branches:
        if isinstance(condition, Const) and not condition.value:
            continue
        if condition is None or isinstance(condition, Const):
            kept.append((None, body))
            break
        kept.append((condition, body))
    return list(kept[0][1]) if kept and kept[0][0] is None else [If(tuple(kept))] if kept else []


def _joined_texts(nodes: list) -> tuple:
    out: list = []
    for node in nodes:
        if isinstance(node, Out) and isinstance(node.expr, Const):
            if out and isinstance(out[-1], Out) and isinstance(out[-1].expr, Const):
                node = Out(Const(f"{out.pop().expr.value}{node.expr.value}"))
        out.append(node)
    return tuple(out)


def _expression(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        if node.field is None:
            return lambda scope, name=node.name: scope.get(name, "")
        return lambda scope, name=node.name, field=node.field: (scope.get(name) or {}).get(field, "")
    f, args = _PURE[node.kind], [_expression(a) for a in node.args]
    if node.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if len(args) == 1:
        return lambda scope, a=args[0]: f(a(scope))
    return lambda scope, a=args[0], b=args[1]: f(a(scope), b(scope))


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _closure(nodes: tuple) -> Render:
    steps = [_step(n) for n in nodes]

    def run(scope: dict, loss: bool):
        for step in steps:
            yield from step(scope, loss)

    return run


def _step(node) -> Render:
    if isinstance(node, Out):
        value = _expression(node.expr)

        def put(scope, loss):
            text = str(value(scope))
            if text:
                yield text, loss

        return put
    if isinstance(node, Generation):
        body = _closure(node.body)
        return lambda scope, loss: body(scope, True)
    if isinstance(node, If):
        branches = [(None if c is None else _expression(c), _closure(b)) for c, b in node.branches]

        def choose(scope, loss):
            for condition, body in branches:
                if condition is None or condition(scope):
                    yield from body(scope, loss)
                    return

        return choose
    body, var = _closure(node.body), node.var

    def loop(scope, loss):
        messages = iter(scope["messages"])
        now, index = next(messages, None), 0
        while now is not None:
            after, index = next(messages, None), index + 1
            yield from body({**scope, var: now, "loop": {"first": index == 1, "last": after is None, "index": index}}, loss)
            yield "", False  # a turn ends here
            now = after

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """Pieces (text, under the loss mask) of a conversation; an empty piece marks the end of a turn."""
    run = _closure(parse(source))
    return lambda messages: run({"messages": messages}, False)
