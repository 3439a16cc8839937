"""A small chat template language: parsed to a syntax tree, constants folded, compiled to Python closures.

Templates have text, ``{{ expression }}`` and the statements for, if/elif/else, set and generation. Expressions
know strings, whole numbers, true, false, none, names, attributes and items of mappings, ``+``, comparisons, ``in``,
``and``/``or``/``not`` and named filters. Nothing else can be reached from a template: attributes are looked up as
keys of mappings only, there are no calls, and filters come from the table given. A dash inside a mark removes the
white space next to it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

MARK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>|.\[\]()]))")
CONSTANTS = {"true": True, "false": False, "none": None}
WORD_OPERATORS = {"and", "or", "not", "in"}
COMPARE: Mapping[str, Callable[[object, object], bool]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}
Env = dict[str, object]
Expression = Callable[[Env], object]


class TemplateError(ValueError):
    """The template is not in the language."""


@dataclass(frozen=True)
class Node:
    """kind const: value; other expressions and statements: args."""

    kind: str
    args: tuple = ()
    value: object = None


class _Parser:
    """Expressions by recursive descent."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            found = TOKEN.match(text, at)
            if not found or found.end() == at:
                raise TemplateError(f"cannot read {text[at:]!r}")
            kinds = ("number", "string", "name", "sign")
            self.tokens.append(next((k, v) for k, v in zip(kinds, found.groups()) if v is not None))
            at = found.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "string"

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or value in WORD_OPERATORS:
            raise TemplateError("expected a name")
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.peek("or"):
            self.at += 1
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.peek("and"):
            self.at += 1
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        if self.peek("not"):
            self.at += 1
            return Node("not", (self.negated(),))
        return self.compared()

    def compared(self) -> Node:
        node = self.sum()
        while self.peek(*COMPARE):
            node = Node("compare", (node, self.sum_after()), self.tokens[self.mark][1])
        return node

    def sum_after(self) -> Node:
        self.mark = self.at
        self.at += 1
        mark = self.mark
        node = self.sum()
        self.mark = mark
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.peek("+"):
            self.at += 1
            node = Node("add", (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek(".", "[", "|"):
            sign = self.take(".", "[", "|")
            if sign == ".":
                node = Node("item", (node, Node("const", value=self.name())))
            elif sign == "[":
                node = Node("item", (node, self.either()))
                self.take("]")
            else:
                node = Node("filter", (node,), self.name())
        return node

    def atom(self) -> Node:
        if self.peek("("):
            self.at += 1
            node = self.either()
            self.take(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends too early")
        kind, value = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Node("const", value=int(value))
        if kind == "string":
            self.at += 1
            return Node("const", value=re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        name = self.name()
        return Node("const", value=CONSTANTS[name]) if name in CONSTANTS else Node("name", value=name)


def parse(source: str) -> list[Node]:
    """Syntax tree of a template: const, emit, for, if, set and generation nodes."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for found in MARK.finditer(source):
        before, expression, after, before_s, statement, after_s = found.groups()
        text = source[at : found.start()]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if before or before_s else text))
        parts.append(("emit", expression) if expression is not None else ("do", statement.strip()))
        at, trim = found.end(), bool(after or after_s)
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    place = 0

    def block(*ends: str) -> tuple[list[Node], str]:
        nonlocal place
        nodes: list[Node] = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                if text:
                    nodes.append(Node("const", value=text))
                continue
            if kind == "emit":
                nodes.append(Node("emit", (_Parser(text).whole(),)))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return nodes, text
            if word == "for":
                found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not found:
                    raise TemplateError(f"cannot read {text!r}")
                body, _ = block("endfor")
                nodes.append(Node("for", (_Parser(found[2]).whole(), tuple(body)), found[1]))
            elif word == "if":
                branches, condition = [], _Parser(rest).whole()
                while True:
                    body, end = block("elif", "else", "endif")
                    branches.append((condition, tuple(body)))
                    if end == "endif":
                        break
                    condition = Node("const", value=True) if end == "else" else _Parser(end[4:]).whole()
                nodes.append(Node("if", tuple(branches)))
            elif word == "set":
                name, _, value = rest.partition("=")
                nodes.append(Node("set", (_Parser(value).whole(),), _Parser(name).name()))
            elif word == "generation":
                body, _ = block("endgeneration")
                nodes.append(Node("generation", (tuple(body),)))
            else:
                raise TemplateError(f"unknown statement {text!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    return block()[0]


def printed(value: object) -> str:
    """How a value appears in the output: none as nothing."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


class _Compiler:
    def __init__(self, filters: Mapping[str, Callable[[object], object]]) -> None:
        self.filters = filters

    def fold(self, node: Node) -> Node:
        """The same expression with everything known evaluated."""
        if node.kind in ("const", "name"):
            return node
        args = tuple(self.fold(arg) for arg in node.args)
        node = Node(node.kind, args, node.value)
        if node.kind == "filter" and node.value not in self.filters:
            raise TemplateError(f"unknown filter {node.value!r}")
        if node.kind in ("and", "or") and args[0].kind == "const":
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        if all(arg.kind == "const" for arg in args):
            return Node("const", value=self.expression(node)({}))
        return node

    def expression(self, node: Node) -> Expression:
        args = [self.expression(arg) for arg in node.args]
        value = node.value
        match node.kind:
            case "const":
                return lambda env: value
            case "name":
                return lambda env: env.get(value)
            case "item":
                def item(env: Env) -> object:
                    whole, key = args[0](env), args[1](env)
                    return whole.get(key) if isinstance(whole, dict) else None
                return item
            case "filter":
                use = self.filters[value]
                return lambda env: use(args[0](env))
            case "add":
                return lambda env: args[0](env) + args[1](env)
            case "compare":
                use = COMPARE[value]
                return lambda env: use(args[0](env), args[1](env))
            case "and":
                return lambda env: args[0](env) and args[1](env)
            case "or":
                return lambda env: args[0](env) or args[1](env)
            case _:
                return lambda env: not args[0](env)

    def fold_block(self, nodes: Sequence[Node]) -> list[Node]:
        """Constant output becomes text, neighbouring text one piece, branches known beforehand their body."""
        out: list[Node] = []
        for node in nodes:
            if node.kind == "emit":
                inner = self.fold(node.args[0])
                folded = [Node("const", value=printed(inner.value)) if inner.kind == "const" else Node("emit", (inner,))]
            elif node.kind == "if":
                branches, folded = [], None
                for condition, body in node.args:
                    condition = self.fold(condition)
                    if condition.kind == "const" and not condition.value:
                        continue
                    branches.append((condition, tuple(self.fold_block(body))))
                    if condition.kind == "const":
                        break
                if not branches:
                    folded = []
                elif branches[0][0].kind == "const":
                    folded = list(branches[0][1])
                else:
                    folded = [Node("if", tuple(branches))]
            elif node.kind == "for":
                folded = [Node("for", (self.fold(node.args[0]), tuple(self.fold_block(node.args[1]))), node.value)]
            elif node.kind == "generation":
                folded = [Node("generation", (tuple(self.fold_block(node.args[0])),))]
            elif node.kind == "set":
                folded = [Node("set", (self.fold(node.args[0]),), node.value)]
            else:
                folded = [node]
            for one in folded:
                if one.kind == "const" and out and out[-1].kind == "const":
                    out[-1] = Node("const", value=out[-1].value + one.value)
                else:
                    out.append(one)
        return out

    def block(self, nodes: Sequence[Node]) -> Callable[[Env, _Output], None]:
        steps = [self.statement(node) for node in nodes]

        def run(env: Env, out: _Output) -> None:
            for step in steps:
                step(env, out)

        return run

    def statement(self, node: Node) -> Callable[[Env, _Output], None]:
        match node.kind:
            case "const":
                text = node.value
                return lambda env, out: out.write(text)
            case "emit":
                value = self.expression(node.args[0])
                return lambda env, out: out.write(printed(value(env)))
            case "set":
                value, name = self.expression(node.args[0]), node.value
                return lambda env, out: env.__setitem__(name, value(env))
            case "if":
                branches = [(self.expression(condition), self.block(body)) for condition, body in node.args]

                def choose(env: Env, out: _Output) -> None:
                    for condition, body in branches:
                        if condition(env):
                            return body(env, out)

                return choose
            case "generation":
                body = self.block(node.args[0])

                def marked(env: Env, out: _Output) -> None:
                    start = out.length
                    body(env, out)
                    out.spans.append((start, out.length))

                return marked
            case _:
                items, body, name = self.expression(node.args[0]), self.block(node.args[1]), node.value

                def loop(env: Env, out: _Output) -> None:
                    values = list(items(env) or [])
                    for at, value in enumerate(values):
                        body(env | {name: value, "loop": loop_state(at, len(values))}, out)

                return loop


class _Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def loop_state(at: int, length: int) -> dict[str, object]:
    """What a loop body sees as ``loop``."""
    return {"index": at + 1, "index0": at, "first": at == 0, "last": at == length - 1, "length": length}


class Template:
    """A compiled template. ``render`` formats a whole conversation; ``turn`` one message of it.

    ``turn`` needs a template whose only use of ``messages`` is one loop at the outermost level: what stands before the loop
    goes to the first message, what stands after it to the last. Variables set outside the loop see no messages.
    """

    def __init__(self, source: str, filters: Mapping[str, Callable[[object], object]]) -> None:
        compiler = _Compiler(filters)
        nodes = compiler.fold_block(parse(source))
        self._all = compiler.block(nodes)
        loops = [at for at, node in enumerate(nodes) if node.kind == "for" and node.args[0] == Node("name", value="messages")]
        self._parts = None
        if len(loops) == 1:
            loop = nodes[loops[0]]
            self._parts = (
                compiler.block(nodes[: loops[0]]), loop.value, compiler.block(loop.args[1]), compiler.block(nodes[loops[0] + 1 :])
            )

    def render(self, messages: Sequence[Mapping[str, object]], **values: object) -> tuple[str, list[tuple[int, int]]]:
        """Text and the spans of its generation parts, in code points."""
        out = _Output()
        self._all({**values, "messages": [dict(message) for message in messages]}, out)
        return "".join(out.parts), out.spans

    def turn(self, message: Mapping[str, object], at: int, length: int, **values: object) -> tuple[str, list[tuple[int, int]]]:
        """The part of ``render``'s text that the message at place ``at`` of ``length`` gives."""
        if self._parts is None:
            raise TemplateError("messages must be used by one outermost loop")
        head, name, body, tail = self._parts
        out = _Output()
        env: Env = dict(values)
        before = out if at == 0 else _Output()
        head(env, before)
        body(env | {name: dict(message), "loop": loop_state(at, length)}, out)
        if at == length - 1:
            tail(env, out)
        return "".join(out.parts), out.spans
