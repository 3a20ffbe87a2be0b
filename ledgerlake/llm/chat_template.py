"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree
is turned into Python closures. A compiled template is a generator of (text, in_loss) pieces, so
a conversation is rendered while its turns stream by: memory is one turn, however long the
conversation. ``{% generation %}`` blocks mark what a model is trained on.

Language: text, ``{{ expression }}``, ``{% for x in expression %}``, ``{% if %}``/``elif``/``else``,
``{% set x = expression %}``, ``{% generation %}`` and ``end...`` tags, ``{# comments #}``. Expressions:
literals, names, ``a.b`` and ``a["b"]`` on mappings only, comparisons, ``in``, ``and``/``or``/``not``, ``+``
and ``~``, ``x if c else y``, filters ``| escape``, ``trim``, ``upper``, ``lower``, ``length``,
``default(v)``. No calls, no attributes of objects, no imports: nothing of Python is reachable.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick

# fixed values: strings with a meaning to chat models that use this or other common formats
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))

TURNS = """{# one block per turn; the text of assistant turns is trained on #}
{%- for m in messages -%}
{{ "<|start|>" }}{{ m.role | escape }}{{ "<|message|>" }}
{%- if m.role == "assistant" -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
{{ "<|end|>" ~ "\\n" }}
{%- endfor -%}"""


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character; backslashes double."""
    return _CONTROL.sub(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\", text)


def unescape(text: str) -> str:
    """Inverse of ``escape``: a doubled backslash is one, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().\[\]|,=]))""")
_FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(), "length": lambda v: len(v), "default": lambda v, d="": d if v is None else v,
}
_COMPARE: dict[str, Callable[[Any, Any], bool]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


class _Expression:
    """Recursive descent over one expression; nodes are tuples ('const', v), ('name', n), ..."""

    def __init__(self, source: str):
        self.items, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.items.append(("end", ""))
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.items[self.at][0] in ("op", "name") and self.items[self.at][1] in values

    def take(self, *values: str) -> str:
        if values and not self.peek(*values):
            raise TemplateError(f"expected {values}, found {self.items[self.at][1]!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.ternary()
        if self.items[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def ternary(self) -> tuple:
        node = self.either()
        if self.peek("if"):
            self.take()
            test = self.either()
            self.take("else")
            node = ("if", test, node, self.ternary())
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        node = self.joined()
        if self.peek(*_COMPARE):
            op = self.take()
            node = ("compare", op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek("+", "~"):
            op = self.take()
            node = ("join" if op == "~" else "add", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.member()
        while self.peek("|"):
            self.take()
            name, args = self.take(), []
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.peek("("):
                self.take()
                while not self.peek(")"):
                    args.append(self.ternary())
                    if self.peek(","):
                        self.take()
                self.take(")")
            node = ("filter", name, node, *args)
        return node

    def member(self) -> tuple:
        node = self.atom()
        while self.peek(".", "["):
            if self.take() == ".":
                node = ("get", node, ("const", self.take()))
            else:
                node = ("get", node, self.ternary())
                self.take("]")
        return node

    def atom(self) -> tuple:
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), value[1:-1]))
        if kind == "num":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if kind == "name" and value not in ("if", "else", "and", "or", "not", "in"):
            return ("name", value)
        if value == "(":
            node = self.ternary()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """Template source -> syntax tree."""
    source = re.sub(r"\s*(\{[{%#])-", r"\1", re.sub(r"-([}%#]\})\s*", r"\1", source))
    root: list[tuple] = []
    stack: list[tuple[str, list]] = [("", root)]
    for piece in _TAG.split(source):
        body = stack[-1][1]
        if piece.startswith("{#") or not piece:
            continue
        if piece.startswith("{{"):
            body.append(("print", _Expression(piece[2:-2]).whole()))
            continue
        if not piece.startswith("{%"):
            body.append(("text", piece))
            continue
        word, _, rest = piece[2:-2].strip().partition(" ")
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"bad loop {rest!r}")
            inner: list[tuple] = []
            body.append(("for", m[1], _Expression(m[2]).whole(), inner))
            stack.append(("endfor", inner))
        elif word == "if":
            arms: list[tuple] = [(_Expression(rest).whole(), [])]
            body.append(("branch", arms))
            stack.append(("endif", arms[0][1]))
        elif word in ("elif", "else"):
            end = stack.pop()[0]
            if end != "endif":
                raise TemplateError(f"{word} without if")
            arms = stack[-1][1][-1][1]
            arms.append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
            stack.append(("endif", arms[-1][1]))
        elif word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError(f"bad set {rest!r}")
            body.append(("set", name.strip(), _Expression(value).whole()))
        elif word == "generation":
            inner = []
            body.append(("generation", inner))
            stack.append(("endgeneration", inner))
        elif word == stack[-1][0] and word:
            stack.pop()
        else:
            raise TemplateError(f"unexpected tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"missing {stack[-1][0]}")
    return root


def fold(tree: list[tuple]) -> list[tuple]:
    """Constants folded: expressions of constants, branches of constant tests, neighbouring texts."""
    out: list[tuple] = []
    for node in tree:
        kind = node[0]
        if kind == "print":
            e = _fold(node[1])
            node = ("text", _text(e[1])) if e[0] == "const" else ("print", e)
        elif kind == "set":
            node = ("set", node[1], _fold(node[2]))
        elif kind == "for":
            node = ("for", node[1], _fold(node[2]), fold(node[3]))
        elif kind == "generation":
            node = ("generation", fold(node[1]))
        elif kind == "branch":
            arms = []
            for test, body in node[1]:
                test = _fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(body)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    _append(out, inner)
                continue
            node = ("branch", arms)
        _append(out, node)
    return out


def _append(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _fold(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    parts = tuple(_fold(x) if isinstance(x, tuple) else x for x in e[1:])
    e = (e[0], *parts)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _expression(e)({}))
    return e


def _expression(e: tuple) -> Callable[[dict], Any]:
    """Closure of an expression over the variables."""
    kind = e[0]
    if kind == "const":
        return lambda v, c=e[1]: c
    if kind == "name":
        return lambda v, n=e[1]: v.get(n)
    if kind == "get":
        a, b = _expression(e[1]), _expression(e[2])
        return lambda v: x.get(b(v)) if isinstance(x := a(v), dict) else None
    if kind == "filter":
        f, args = _FILTERS[e[1]], [_expression(x) for x in e[2:]]
        return lambda v: f(*(a(v) for a in args))
    if kind == "compare":
        f, a, b = _COMPARE[e[1]], _expression(e[2]), _expression(e[3])
        return lambda v: f(a(v), b(v))
    if kind == "not":
        a = _expression(e[1])
        return lambda v: not a(v)
    if kind == "if":
        t, a, b = (_expression(x) for x in e[1:])
        return lambda v: a(v) if t(v) else b(v)
    a, b = _expression(e[1]), _expression(e[2])
    return {
        "and": lambda v: a(v) and b(v), "or": lambda v: a(v) or b(v),
        "add": lambda v: a(v) + b(v), "join": lambda v: _text(a(v)) + _text(b(v)),
    }[kind]


Piece = tuple[str, bool]


def _closure(tree: list[tuple]) -> Callable[[dict, bool], Iterator[Piece]]:
    steps = [_step(node) for node in tree]

    def run(v: dict, loss: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(v, loss)

    return run


def _step(node: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda v, loss, t=node[1]: iter(((t, loss),))
    if kind == "print":
        e = _expression(node[1])
        return lambda v, loss: iter(((_text(e(v)), loss),))
    if kind == "set":
        e = _expression(node[2])

        def assign(v, loss):
            v[node[1]] = e(v)
            return iter(())

        return assign
    if kind == "generation":
        inner = _closure(node[1])
        return lambda v, loss: inner(v, True)
    if kind == "branch":
        arms = [(_expression(t), _closure(b)) for t, b in node[1]]
        return lambda v, loss: next((b(v, loss) for t, b in arms if t(v)), iter(()))
    e, inner = _expression(node[2]), _closure(node[3])

    def loop(v, loss):
        for i, x in enumerate(e(v) or ()):
            yield from inner({**v, node[1]: x, "loop": {"index": i + 1, "index0": i, "first": i == 0}}, loss)

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """Compiled template: variables -> (text, in_loss) pieces. Iterables may be consumed once."""
    body = _closure(fold(parse(source)))
    return lambda variables: body(dict(variables), False)


class Reader:
    """Reads turns back from a formatted stream, holding at most one turn."""

    def __init__(self) -> None:
        self.text, self.mask = "", []  # mask: (start, end) of loss text within self.text
        self.turns: list[tuple[str, str, str | None]] = []

    def feed(self, piece: str, loss: bool) -> Iterable[tuple[str, str, str | None]]:
        """Turns completed by this piece: (role, text, loss text or None)."""
        if loss:
            self.mask.append((len(self.text), len(self.text) + len(piece)))
        self.text += piece
        done = []
        while (end := self.text.find(END + "\n")) >= 0:
            if not self.text.startswith(START):
                raise ValueError("not a turn")
            role, _, body = self.text[len(START) : end].partition(MESSAGE)
            inside = [(a, b) for a, b in self.mask if a < end]
            marked = unescape("".join(self.text[a:b] for a, b in inside)) if inside else None
            done.append((unescape(role), unescape(body), marked))
            cut = end + len(END) + 1
            self.mask = [(a - cut, b - cut) for a, b in self.mask if a >= cut]
            self.text = self.text[cut:]
        return done


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TURNS) -> DataFrame:
    """(id_col, seq, piece, in_loss): the formatted conversations as ordered pieces.

    Concatenating a conversation's pieces by ``seq`` gives its formatted text; ``in_loss`` is the
    generation mask. Turns are ordered by turn, then role, then text, so ties and repeated rows have
    a fixed order; nulls sort first; null role and text are empty; rows of null id form one
    conversation. A conversation lives in one task, as its text is one sequence, but it streams.
    """
    kind = turns.schema[id_col].dataType.simpleString()

    def scan(batches):
        out: list[tuple] = []
        for conv, pieces in _rendered(batches, template):
            for seq, (text, loss) in enumerate(pieces):
                out.append((conv, seq, text, loss))
                if len(out) >= 2000:
                    yield _batch(out, ids, ["id", "seq", "piece", "in_loss"], [None, pa.int64(), pa.string(), pa.bool_()])
                    out = []
        if out:
            yield _batch(out, ids, ["id", "seq", "piece", "in_loss"], [None, pa.int64(), pa.string(), pa.bool_()])

    ids = _arrow_type(turns, id_col)
    return _ordered(turns, id_col, turn_col, role_col, text_col).mapInArrow(scan, f"id {kind}, seq long, piece string, in_loss boolean").withColumnRenamed("id", id_col)


def conversation_digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TURNS) -> DataFrame:
    """(id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the
    formatted stream of each conversation (the rules are those of ``format_conversations``)."""
    kind = turns.schema[id_col].dataType.simpleString()
    ids = _arrow_type(turns, id_col)
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def scan(batches):
        out = []
        for conv, pieces in _rendered(batches, template):
            reader, turn_hash, loss_hash = Reader(), hashlib.sha256(), hashlib.sha256()
            n = chars = formatted = 0
            for piece, loss in pieces:
                formatted += len(piece)
                for role, text, marked in reader.feed(piece, loss):
                    n += 1
                    turn_hash.update(f"{role}\n{text}\n".encode())
                    if marked is not None:
                        chars += len(marked)
                        loss_hash.update(marked.encode())
            if reader.text:
                raise ValueError("the template left an unfinished turn")
            out.append((conv, n, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted))
            if len(out) >= 2000:
                yield _batch(out, ids, names, types)
                out = []
        if out:
            yield _batch(out, ids, names, types)

    return _ordered(turns, id_col, turn_col, role_col, text_col).mapInArrow(scan, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)


def _ordered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    t = pick(turns, id=id_col, turn=turn_col, role=role_col, text=text_col)
    t = t.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    return t.repartition("id").sortWithinPartitions("id", "turn", "role", "text")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _batch(rows: list[tuple], ids: pa.DataType, names: list[str], types: list) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t or ids) for c, t in zip(cols, types, strict=True)], names)


def _rendered(batches, template: str) -> Iterator[tuple[Any, Iterator[Piece]]]:
    """(conversation, pieces) of sorted rows; the pieces must be used up before the next one."""
    render = compile_template(template)
    rows = ((i, {"role": r, "text": t}) for b in batches for i, r, t in zip(b["id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def turns():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1]
                ahead = next(rows, None)

        yield conv, render({"messages": turns()})
