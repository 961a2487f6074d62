"""Chat formatting: a small sandboxed template language, compiled to Python closures, over conversations.

A template is text with ``{{ expression }}`` and ``{% statement %}``. Statements: ``for x in y``, ``if``, ``elif``,
``else``, ``set x = expression``, ``generation`` (what it renders is under the loss mask), each block closed by
``end`` and its name. Expressions: strings, whole numbers, ``true``, ``false``, ``none``, names, ``a.b`` and ``a['b']``
(a key of a mapping, never a Python attribute), ``~`` (joins as text), ``==``, ``!=``, ``in``, ``not``, ``and``,
``or``, parentheses, and filters ``a | name``. Templates can call nothing and change nothing outside their own variables.

It is compiled in three steps: parse to a syntax tree, fold constants, generate closures. A closure yields pieces
of output as it goes, so a conversation is rendered from a stream of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codepoints of a part of a formatted conversation, about; a longer one takes several rows.
PART = 1 << 20

TURN, END = "<|im_start|>", "<|im_end|>\n"
#: Turns with role and text; control strings inside either are escaped; assistants' texts are under the mask.
CHATML = TURN + "{{ m.role | line | escape }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + END
CHATML = "{% for m in messages %}" + CHATML + "{% endfor %}"


class TemplateError(ValueError):
    pass


# What may break a turn's frame: "<|" anywhere, and a line break in a role. Each gets one more backslash than it has.
_FRAME, _FRAMED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _FRAME.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _FRAMED.sub(r"<\1|", text) if "<" in text else text


def as_line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def from_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)),
    "line": lambda x: as_line(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "lower": lambda x: _text(x).lower(),
    "upper": lambda x: _text(x).upper(),
    "length": len,
}


def _text(x: Any) -> str:
    return "" if x is None else {True: "true", False: "false"}[x] if isinstance(x, bool) else str(x)


# The syntax tree ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operation on expressions: a key, a filter, or an operator."""

    kind: str
    parts: tuple


@dataclass(frozen=True)
class Put:
    what: Any


@dataclass(frozen=True)
class Assign:
    name: str
    what: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Marked:
    body: tuple


_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~.|()\[\]=]))""", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    """A parser of one expression: ``or`` binds loosest, then ``and``, ``not``, comparison, ``~``, filters and keys."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens += [(kind, m[i]) for i, kind in enumerate(("text", "number", "name", "sign"), 1) if m[i] is not None]
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, *wanted: str) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind and (not wanted or self.tokens[self.at][1] in wanted):
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"expected {' or '.join(wanted) or kind}")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        out = self.either()
        self.end()
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = Apply("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = Apply("and", (out, self.negated()))
        return out

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        out = self.joined()
        while sign := self.take("==", "!=", "in"):
            out = Apply(sign, (out, self.joined()))
        return out

    def joined(self):
        out = self.filtered()
        while self.take("~"):
            out = Apply("~", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.keyed()
        while self.take("|"):
            if (name := self.need("name")) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Apply("filter", (Const(name), out))
        return out

    def keyed(self):
        out = self.single()
        while sign := self.take(".", "["):
            if sign == ".":
                out = Apply("key", (out, Const(self.need("name"))))
            else:
                out = Apply("key", (out, self.either()))
                self.need("sign", "]")
        return out

    def single(self):
        if self.take("("):
            out = self.either()
            self.need("sign", ")")
            return out
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(template):
        parts += [("text", template[at : m.start()]), ("put", m[1]) if m[1] is not None else ("do", m[2])]
        at = m.end()
    parts.append(("text", template[at:]))
    place = 0

    def block(*stops: str) -> tuple[tuple, str, _Expression | None]:
        nonlocal place
        out: list = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                out += [Put(Const(value))] if value else []
            elif kind == "put":
                out.append(Put(_Expression(value).whole()))
            else:
                rest = _Expression(value)
                word = rest.need("name")
                if word in stops:
                    return tuple(out), word, rest
                out.append(statement(word, rest))
        if stops:
            raise TemplateError(f"{' or '.join(stops)} is missing")
        return tuple(out), "", None

    def closed(name: str) -> tuple:
        body, _, rest = block(name)
        rest.end()
        return body

    def choice(rest: _Expression) -> Choice:
        test = rest.whole()
        body, word, rest = block("elif", "else", "endif")
        if word == "elif":
            return Choice(test, body, (choice(rest),))
        rest.end()
        return Choice(test, body, closed("endif") if word == "else" else ())

    def statement(word: str, rest: _Expression):
        if word == "for":
            name = rest.need("name")
            rest.need("name", "in")
            over = rest.whole()
            return Loop(name, over, closed("endfor"))
        if word == "if":
            return choice(rest)
        if word == "set":
            name = rest.need("name")
            rest.need("sign", "=")
            return Assign(name, rest.whole())
        if word == "generation":
            rest.end()
            return Marked(closed("endgeneration"))
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


# Constant folding --------------------------------------------------------------------------------------------------


def _operate(kind: str, values: list) -> Any:
    a = values[0]
    if kind == "filter":
        return FILTERS[a](values[1])
    if kind == "key":
        return a.get(values[1]) if isinstance(a, dict) else None
    if kind == "not":
        return not a
    b = values[1]
    if kind == "~":
        return _text(a) + _text(b)
    if kind == "in":
        return b is not None and a in b
    return (a == b) == (kind == "==")


def folded(node):
    """The same tree with what is known beforehand computed, branches never taken left out and neighbouring texts joined."""
    if isinstance(node, Apply):
        parts = tuple(folded(p) for p in node.parts)
        if node.kind in ("and", "or"):
            if isinstance(parts[0], Const):
                return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
        elif all(isinstance(p, Const) for p in parts):
            return Const(_operate(node.kind, [p.value for p in parts]))
        return Apply(node.kind, parts)
    if isinstance(node, Put):
        what = folded(node.what)
        return Put(Const(_text(what.value)) if isinstance(what, Const) else what)
    if isinstance(node, Assign):
        return Assign(node.name, folded(node.what))
    if isinstance(node, Loop):
        return Loop(node.name, folded(node.over), folded(node.body))
    if isinstance(node, Marked):
        return Marked(folded(node.body))
    if isinstance(node, Choice):
        return Choice(folded(node.test), folded(node.body), folded(node.other))
    if isinstance(node, tuple):
        flat: list = []
        for x in map(folded, node):
            if isinstance(x, Choice) and isinstance(x.test, Const):
                flat += x.body if x.test.value else x.other
            else:
                flat.append(x)
        out: list = []
        for x in flat:
            if isinstance(x, Put) and isinstance(x.what, Const):
                if not x.what.value:
                    continue
                if out and isinstance(out[-1], Put) and isinstance(out[-1].what, Const):
                    out[-1] = Put(Const(out[-1].what.value + x.what.value))
                    continue
            out.append(x)
        return tuple(out)
    return node


# Closures ----------------------------------------------------------------------------------------------------------

#: Pieces of output, each with whether it is under the mask.
Pieces = Iterator[tuple[str, bool]]


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope, x=node.value: x
    if isinstance(node, Name):
        return lambda scope, x=node.name: scope.get(x)
    parts = [_value(p) for p in node.parts]
    if node.kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if node.kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope, kind=node.kind: _operate(kind, [p(scope) for p in parts])


def _body(nodes: tuple) -> Callable[[dict, bool], Pieces]:
    steps = [_run(x) for x in nodes]

    def run(scope: dict, mask: bool) -> Pieces:
        for step in steps:
            yield from step(scope, mask)

    return run


def _run(node) -> Callable[[dict, bool], Pieces]:
    if isinstance(node, Put):
        value = _value(node.what)

        def run(scope: dict, mask: bool) -> Pieces:
            yield _text(value(scope)), mask

    elif isinstance(node, Assign):
        value = _value(node.what)

        def run(scope: dict, mask: bool) -> Pieces:
            scope[node.name] = value(scope)
            yield from ()

    elif isinstance(node, Loop):
        over, body = _value(node.over), _body(node.body)

        def run(scope: dict, mask: bool) -> Pieces:
            # an inner scope for each turn; the next turn is read ahead, to know which is the last
            items = iter(over(scope) or ())
            number, more, item = 0, *_ahead(items)
            while more:
                now, (more, item) = item, _ahead(items)
                yield from body({**scope, node.name: now, "loop": {"index": number + 1, "first": number == 0, "last": not more}}, mask)
                number += 1

    elif isinstance(node, Choice):
        test, body, other = _value(node.test), _body(node.body), _body(node.other)

        def run(scope: dict, mask: bool) -> Pieces:
            return body(scope, mask) if test(scope) else other(scope, mask)

    else:
        body = _body(node.body)

        def run(scope: dict, mask: bool) -> Pieces:
            return body(scope, True)

    return run


def _ahead(items: Iterator) -> tuple[bool, Any]:
    for x in items:
        return True, x
    return False, None


def compiled(template: str) -> Callable[[dict], Pieces]:
    """A function from variables to pieces of output."""
    run = _body(folded(parse(template)))
    return lambda variables: run(dict(variables), False)


# Spark jobs --------------------------------------------------------------------------------------------------------

_PARTS = "conv_id long, part long, last boolean, formatted string, mask_from array<int>, mask_to array<int>"


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, dict[str, str]]]:
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield conv, {"role": role or "", "text": text or ""}


def _parts_of(pieces: Pieces, size: int) -> Iterator[tuple[str, list[int], list[int]]]:
    """Pieces joined to parts of about ``size``, with the spans under the mask; an empty output is one empty part."""
    held: list[str] = []
    n, first, last = 0, [], []
    for text, mask in pieces:
        if mask and text:
            if last and last[-1] == n:
                last[-1] += len(text)
            else:
                first.append(n)
                last.append(n + len(text))
        held.append(text)
        n += len(text)
        if n >= size:
            yield "".join(held), first, last
            held, n, first, last = [], 0, [], []
    yield "".join(held), first, last


def format_conversations(rows: DataFrame, template: str = CHATML, part: int = PART, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations rendered by a template: conv_id, part (from 0), last, formatted, mask_from, mask_to (codepoints in the part).

    The template gets ``messages``, the conversation's rows by turn; rows of one turn follow role and text, rows
    without turn come first. A null role or text is empty, rows without conv_id are a conversation of their own. A
    conversation takes several rows where it is longer than ``part``; they follow each other in one partition. A
    task streams its conversations, so it holds a turn and a part, not a conversation. A template that can't be
    parsed raises TemplateError at once.
    """
    render = compiled(template)
    columns = [rows[conv_col].cast("long").alias("conv_id"), rows[role_col].alias("role"), rows[text_col].alias("text"), rows[turn_col].cast("long").alias("turn")]
    ordered = rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _turns(batches)
        more, held = _ahead(turns)
        out: list[tuple] = []
        size = 0
        while more:
            conv = held[0]

            def own() -> Iterator[dict]:
                nonlocal more, held
                while more and held[0] == conv:
                    yield held[1]
                    more, held = _ahead(turns)

            messages = own()
            waiting, number = None, 0
            for made in _parts_of(render({"messages": messages}), part):
                if waiting is not None:
                    out.append((conv, number, False, *waiting))
                    number += 1
                waiting = made
                size += len(made[0])
                if size >= part:
                    yield _part_rows(out)
                    out, size = [], len(made[0])
            out.append((conv, number, True, *waiting))
            for _ in messages:  # turns that the template didn't read
                pass
        yield _part_rows(out)

    return ordered.select("conv_id", "role", "text").mapInArrow(run, _PARTS)


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "part", "last", "formatted", "mask_from", "mask_to"])


class _Reader:
    """What a formatted conversation says, part by part: turns, and texts under the mask."""

    def __init__(self):
        self.turns, self.chars, self.masked = 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest = ""
        self.cut = ""  # the end of masked text that may be half an escape

    def add(self, text: str, first: list[int], last: list[int]) -> None:
        self.chars += len(text)
        for a, b in zip(first, last, strict=True):
            if a:
                self._loss("", True)
            self._loss(text[a:b], b < len(text))
        if not first or last[-1] < len(text):
            self._loss("", True)
        pieces = (self.rest + text).split(END)
        self.rest = pieces.pop()
        for turn in pieces:
            if not turn.startswith(TURN):
                raise ValueError("a turn's start is missing")
            role, _, own = turn[len(TURN) :].partition("\n")
            self.turns += 1
            self.said.update(f"{from_line(unescape(role))}\n{unescape(own)}\n".encode())

    def _loss(self, text: str, whole: bool) -> None:
        text = self.cut + text
        self.cut = ""
        if not whole and (m := re.search(r"<\\*$", text)):
            text, self.cut = text[: m.start()], m[0]
        plain = unescape(text)
        self.masked += len(plain)
        self.loss.update(plain.encode())

    def row(self, conv: int | None) -> tuple:
        if self.rest:
            raise ValueError("a turn's end is missing")
        self._loss("", True)
        return conv, self.turns, self.said.hexdigest(), self.masked, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """Conversations read from their parts (as ``format_conversations`` orders them, in CHATML's frame).

    conv_id, n_turns, turns_sha256 (of role, line break, text, line break of each turn), loss_chars, loss_sha256 (of
    all text under the mask, unescaped), formatted_chars. Output that isn't in that frame raises ValueError.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            out = []
            for conv, last, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                reader.add(text, a, b)
                if last:
                    out.append(reader.row(conv))
                    reader = _Reader()
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return parts.mapInArrow(run, schema)
