"""Chat formatting with a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures. It has text, ``{{ value }}``, ``{% for x in list %}``, ``{% if %}`` with
``elif`` and ``else``, and ``{% generation %}``, whose output is the loss mask. Values are
names, fields of a message, strings, ``==``, ``!=``, ``and``, ``or``, ``not``, ``+`` and
filters. There are no calls, no indexes and no access to Python objects.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import arrow_batches

# The default format. Turns other than the assistant's stand between [INST] marks.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)


@dataclass
class Node:
    kind: str
    value: Any = None
    parts: list = field(default_factory=list)


_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_SIGN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)|(==|!=|\+|\||\(|\)))", re.S)


class TemplateError(ValueError):
    pass


class _Expression:
    """Parser of one value, by descent: or, and, not, comparison, sum, filters."""

    def __init__(self, text: str):
        self.signs: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _SIGN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            kind = "string" if m[1] else "name" if m[2] else "sign"
            self.signs.append((kind, m[1] or m[2] or m[3]))
            at = m.end()
        self.at = 0

    def whole(self) -> Node:
        node = self.any_of()
        if self.at < len(self.signs):
            raise TemplateError(f"unexpected {self.signs[self.at][1]!r}")
        return node

    def take(self, *values: str) -> str | None:
        if self.at < len(self.signs) and self.signs[self.at][0] != "string" and self.signs[self.at][1] in values:
            self.at += 1
            return self.signs[self.at - 1][1]
        return None

    def any_of(self) -> Node:
        node = self.all_of()
        while self.take("or"):
            node = Node("or", parts=[node, self.all_of()])
        return node

    def all_of(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", parts=[node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", parts=[self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.summed()
        sign = self.take("==", "!=")
        return Node(sign, parts=[node, self.summed()]) if sign else node

    def summed(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("+", parts=[node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.single()
        while self.take("|"):
            if self.at >= len(self.signs) or self.signs[self.at][0] != "name":
                raise TemplateError("a filter has no name")
            node = Node("filter", self.signs[self.at][1], [node])
            self.at += 1
        return node

    def single(self) -> Node:
        if self.take("("):
            node = self.any_of()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return node
        if self.at >= len(self.signs) or self.signs[self.at][0] == "sign":
            raise TemplateError("a value is missing")
        kind, text = self.signs[self.at]
        self.at += 1
        if kind == "string":
            return Node("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        return Node("constant", text == "true") if text in ("true", "false") else Node("name", text.split("."))


def parse(template: str) -> Node:
    """Syntax tree of a template."""
    root = Node("block")
    stack = [root]
    closes = {"for": "endfor", "if": "endif", "generation": "endgeneration"}
    at = 0
    for m in _PART.finditer(template):
        if m.start() > at:
            stack[-1].parts.append(Node("constant", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1].parts.append(_Expression(m[1]).whole())
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            head = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+([A-Za-z_][\w.]*)", rest.strip())
            if not head:
                raise TemplateError(f"cannot read for {rest!r}")
            stack.append(Node("for", (head[1], head[2].split("."))))
        elif word == "if":
            stack += [Node("if"), Node("branch", _Expression(rest).whole())]
        elif word in ("elif", "else") and stack[-1].kind == "branch" and stack[-1].value is not None:
            stack[-2].parts.append(stack.pop())
            stack.append(Node("branch", _Expression(rest).whole() if word == "elif" else None))
        elif word == "generation":
            stack.append(Node("generation"))
        elif word in closes.values():
            if stack[-1].kind == "branch":
                stack[-2].parts.append(stack.pop())
            if closes.get(stack[-1].kind) != word:
                raise TemplateError(f"{word} closes nothing")
            done = stack.pop()
            stack[-1].parts.append(done)
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1].kind} is not closed")
    if at < len(template):
        root.parts.append(Node("constant", template[at:]))
    return root


def _text(value: Any) -> str:
    return "" if value is None or value is False else value if isinstance(value, str) else "true" if value is True else ""


def _same(a: Any, b: Any) -> bool:
    return ("" if a is None else a) == ("" if b is None else b)


_OPERATIONS: dict[str, Callable] = {
    "==": _same,
    "!=": lambda a, b: not _same(a, b),
    "+": lambda a, b: _text(a) + _text(b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def fold_constants(node: Node, filters: dict[str, Callable[[str], str]]) -> Node:
    """The tree with constant values computed, dead branches gone and neighbouring texts joined."""
    parts = [fold_constants(p, filters) for p in node.parts]
    if node.kind in _OPERATIONS and all(p.kind == "constant" for p in parts):
        return Node("constant", _OPERATIONS[node.kind](*(p.value for p in parts)))
    if node.kind == "filter":
        if node.value not in filters:
            raise TemplateError(f"unknown filter {node.value!r}")
        if parts[0].kind == "constant":
            return Node("constant", filters[node.value](_text(parts[0].value)))
    if node.kind == "if":
        kept = []
        for branch in parts:
            if branch.value is not None and branch.value.kind == "constant":
                if not branch.value.value:
                    continue
                branch = Node("branch", None, branch.parts)
            kept.append(branch)
            if branch.value is None:
                break
        if not kept:
            return Node("constant", "")
        return Node("block", None, kept[0].parts) if kept[0].value is None else Node("if", None, kept)
    if node.kind in ("block", "branch", "for", "generation"):
        joined: list[Node] = []
        for p in (q for p in parts for q in (p.parts if p.kind == "block" else [p])):
            if p.kind == "constant" and joined and joined[-1].kind == "constant":
                joined[-1] = Node("constant", _text(joined[-1].value) + _text(p.value))
            else:
                joined.append(p)
        parts = joined
    value = fold_constants(node.value, filters) if node.kind == "branch" and node.value is not None else node.value
    return Node(node.kind, value, parts)


class _Output:
    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _lookup(path: list[str]) -> Callable[[dict], Any]:
    if len(path) == 1:
        name = path[0]
        return lambda env: env.get(name)
    first, *rest = path

    def get(env: dict) -> Any:
        value = env.get(first)
        for key in rest:
            value = value.get(key) if isinstance(value, dict) else None
        return value

    return get


def _value(node: Node, filters: dict) -> Callable[[dict], Any]:
    if node.kind == "constant":
        constant = node.value
        return lambda env: constant
    if node.kind == "name":
        return _lookup(node.value)
    inner = [_value(p, filters) for p in node.parts]
    if node.kind == "filter":
        change, of = filters[node.value], inner[0]
        return lambda env: change(_text(of(env)))
    if node.kind in ("and", "or"):
        a, b = inner
        return (lambda env: a(env) and b(env)) if node.kind == "and" else (lambda env: a(env) or b(env))
    operation = _OPERATIONS[node.kind]
    return lambda env: operation(*(f(env) for f in inner))


def _closure(node: Node, filters: dict) -> Callable[[dict, _Output], None]:
    if node.kind == "for":
        name, source = node.value[0], _lookup(node.value[1])
        body = _closure(Node("block", None, node.parts), filters)

        def loop(env: dict, out: _Output) -> None:
            items = source(env)
            for item in items if isinstance(items, list) else ():
                body(env | {name: item}, out)

        return loop
    if node.kind == "if":
        branches = [(None if b.value is None else _value(b.value, filters), _closure(Node("block", None, b.parts), filters)) for b in node.parts]

        def choose(env: dict, out: _Output) -> None:
            for test, body in branches:
                if test is None or test(env):
                    return body(env, out)

        return choose
    if node.kind in ("block", "generation"):
        steps = [_closure(p, filters) for p in node.parts]

        def run(env: dict, out: _Output) -> None:
            for step in steps:
                step(env, out)

        if node.kind == "block":
            return run

        def generate(env: dict, out: _Output) -> None:
            start = out.length
            run(env, out)
            out.spans.append((start, out.length))

        return generate
    value = _value(node, filters)
    return lambda env, out: out.add(_text(value(env)))


@dataclass(frozen=True)
class Format:
    """A template with its control strings.

    A control string's first sign must not occur further inside any of them; then escaping
    is unambiguous and can be undone.
    """

    template: str = TEMPLATE
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        firsts = {c[0] for c in self.controls}
        if "\\" in firsts or any(f in c[1:] for c in self.controls for f in firsts):
            raise TemplateError("control strings overlap")

    def _any(self) -> str:
        return "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True))

    def escape(self, text: str) -> str:
        """A backslash before every backslash and every control string."""
        return re.sub(rf"\\|{self._any()}", lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def compiled(self) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
        filters = {"escape": self.escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}
        body = _closure(fold_constants(parse(self.template), filters), filters)

        def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
            out = _Output()
            body({"messages": messages}, out)
            return "".join(out.pieces), out.spans

        return render

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """The control strings (True) and the unescaped texts between them, in order."""
        out: list[tuple[bool, str]] = []
        at = 0
        for m in re.finditer(rf"\\.|({self._any()})", text, flags=re.S):
            if m[1]:
                out += [(False, self.unescape(text[at : m.start()])), (True, m[1])]
                at = m.end()
        return [*out, (False, self.unescape(text[at:]))]

    def turns(self, text: str) -> list[tuple[str, str]]:
        """Roles and texts read back from the default template's output."""
        out, where = [], None
        for control, value in self.pieces(text):
            if control:
                where = {"[ROLE]": "role", "[/ROLE]": "text", "[INST]": "text", "<s>": "start"}.get(value)
                if value == "<s>":
                    out.append(["", ""])
            elif where in ("role", "text"):
                out[-1][where == "text"] += value
        return [(r, t) for r, t in out]


def format_conversations(rows: DataFrame, how: Format | None = None) -> DataFrame:
    """One text for each conversation of ``rows`` (conv_id, turn, role, text).

    Returns conv_id, formatted, loss (spans of code points under the loss mask, ends
    exclusive). Turns are in ascending order, nulls first; rows of one turn by role and text.
    Null roles and texts are empty; rows with a null conv_id are one conversation. Rows are
    sorted inside a partition and read as a stream, so a task holds one conversation at a time.
    """
    how = how or Format()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", span)])

    def render_all(batches):
        render = how.compiled()
        done: list[tuple] = []
        key, messages, started, chars = None, [], False, 0

        def close():
            text, spans = render(messages)
            done.append((key, text, [{"start": a, "end": b} for a, b in spans]))
            return len(text)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(schema)], schema=schema)

        for b in batches:
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if started and conv != key:
                    chars += close()
                    messages = []
                    if chars > 4_000_000:
                        yield batch()
                        done, chars = [], 0
                key, started = conv, True
                messages.append({"role": role or "", "text": text or ""})
        if started:
            close()
            yield batch()

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        render_all, "conv_id long, formatted string, loss array<struct<start:bigint,end:bigint>>"
    )


def digests(formatted: DataFrame, how: Format | None = None) -> DataFrame:
    """What the default template's output says, read back from it: counts and digests of turns and loss."""
    how = how or Format()
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def read(batch: pa.RecordBatch) -> dict:
        out: dict = {f.name: [] for f in schema}
        out["conv_id"] = batch.column("conv_id")
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = how.turns(text)
            learnt = "".join(how.unescape(text[x["start"] : x["end"]]) for x in loss)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(learnt))
            out["loss_sha256"].append(hashlib.sha256(learnt.encode()).hexdigest())
            out["formatted_chars"].append(len(text))
        return out

    return formatted.mapInArrow(
        arrow_batches(read, schema),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
