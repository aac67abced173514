"""Chat formatting with a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants
are folded, and the tree is turned into Python closures.  There are no calls,
no imports and no attribute access beyond the fields handed in; anything else
is refused when the template is compiled.

    {{ expression }}                      output
    {% for turn in turns %}..{% endfor %} once per turn
    {% if expression %}..{% elif ..%}..{% else %}..{% endif %}
    {% generation %}..{% endgeneration %} output under the loss mask

Expressions: 'text', names (the loop variable's .role, .text, .index), ``==``,
``!=``, ``+``, ``not``, ``and``, ``or``, parentheses and ``| filter``.

The rendering closures are generators and pull the turns one by one, so a
conversation of any length is rendered in the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import written

# --- escaping ----------------------------------------------------------------

HEAD, TAIL = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_NAME_CONTROL = re.compile(r"\\|###|</turn>|\n")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before every control string; undone by ``unescape``."""
    return _CONTROL.sub(r"\\\g<0>", text)


def escape_name(text: str) -> str:
    return _NAME_CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": escape_name, "trim": str.strip, "upper": str.upper}

DEFAULT = ("{% for turn in turns %}" + HEAD + "{{ turn.role | name }}\n{% if turn.role == 'assistant' %}{% generation %}"
           "{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}" + TAIL
           + "{% endfor %}")


# --- syntax tree ---------------------------------------------------------------

class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    variable: str
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: object


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    variable: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[.+|()]))")
FIELDS = ("role", "text", "index")


class _Expression:
    def __init__(self, source: str, variables: tuple[str, ...]):
        self.tokens, self.variables, at = [], variables, 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted=None):
        t = self.peek()
        if t is None or wanted is not None and t != wanted:
            raise TemplateError(f"{wanted or 'more'} expected, not {t}")
        self.at += 1
        return t

    def whole(self):
        node = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()}")
        return node

    def _chain(self, words, below):
        node = below()
        while self.peek() in words:
            node = Op(self.take(), (node, below()))
        return node

    def either(self):
        return self._chain(("or",), self.both)

    def both(self):
        return self._chain(("and",), self.negated)

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negated(),))
        return self._chain(("==", "!="), self.joined)

    def joined(self):
        return self._chain(("+",), self.filtered)

    def filtered(self):
        node = self.primary()
        while self.peek() == "|":
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = Filter(name, node)
        return node

    def primary(self):
        t = self.take()
        if t == "(":
            node = self.either()
            self.take(")")
            return node
        if t[0] == "'":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1], flags=re.S))
        if t not in self.variables:
            raise TemplateError(f"no variable {t}")
        self.take(".")
        name = self.take()
        if name not in FIELDS:
            raise TemplateError(f"no field {name}")
        return Field(t, name)


def parse(source: str) -> tuple:
    """Template text to a tuple of nodes."""
    pieces = [p for p in _PIECE.split(source) if p]
    at = 0

    def block(ends: tuple[str, ...], variables: tuple[str, ...]):
        nonlocal at
        out = []
        while at < len(pieces):
            p = pieces[at]
            at += 1
            if p.startswith("{{"):
                out.append(Out(_Expression(p[2:-2], variables).whole()))
            elif p.startswith("{%"):
                words = p[2:-2].split()
                head = words[0] if words else ""
                if head in ends:
                    return tuple(out), p[2:-2].strip()
                if head == "for":
                    if len(words) != 4 or words[2:] != ["in", "turns"] or not words[1].isidentifier() or variables:
                        raise TemplateError("only one loop, over turns, is known")
                    out.append(For(words[1], block(("endfor",), (*variables, words[1]))[0]))
                elif head == "if":
                    out.append(branch(p[2:-2].strip()[2:], variables))
                elif head == "generation":
                    out.append(Generation(block(("endgeneration",), variables)[0]))
                else:
                    raise TemplateError(f"unknown statement {p}")
            else:
                out.append(Out(Const(p)))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branch(test: str, variables):
        yes, end = block(("elif", "else", "endif"), variables)
        no: tuple = ()
        if end.startswith("elif"):
            no = (branch(end[4:], variables),)
        elif end == "else":
            no = block(("endif",), variables)[0]
        return If(_Expression(test, variables).whole(), yes, no)

    return block((), ())[0]


_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: str(a) + str(b),
                             "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(node):
    """The same tree with constant parts computed: operators and filters on
    constants, decided branches, and neighbouring constant outputs joined."""
    if isinstance(node, tuple):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, tuple) else (n,):
                if isinstance(x, Out) and isinstance(x.value, Const):
                    if x.value.value == "":
                        continue
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        out[-1] = Out(Const(str(out[-1].value.value) + str(x.value.value)))
                        continue
                out.append(x)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.name](*(a.value for a in args)))
        return Op(node.name, args)
    if isinstance(node, Filter):
        arg = fold(node.arg)
        return Const(FILTERS[node.name](str(arg.value))) if isinstance(arg, Const) else Filter(node.name, arg)
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return If(test, fold(node.yes), fold(node.no))
    if isinstance(node, For):
        return For(node.variable, fold(node.body))
    if isinstance(node, Generation):
        body = fold(node.body)
        return Generation(body) if body else ()
    return node


# --- code generation -------------------------------------------------------------

TURN_END = None


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Field):
        name = node.name
        return lambda env: env[name]
    if isinstance(node, Filter):
        f, arg = FILTERS[node.name], _value(node.arg)
        return lambda env: f(str(arg(env)))
    f, args = _OPS[node.name], [_value(a) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    if len(args) == 1:
        return lambda env: f(args[0](env))
    return lambda env: f(args[0](env), args[1](env))


def _nodes(nodes: tuple, masked: bool) -> Callable[[dict, Iterable], Iterator]:
    parts = [_node(n, masked) for n in nodes]

    def run(env, turns):
        for p in parts:
            yield from p(env, turns)
    return run


def _node(node, masked: bool):
    if isinstance(node, Out):
        value = _value(node.value)

        def out(env, turns):
            yield str(value(env)), masked
        return out
    if isinstance(node, If):
        test, yes, no = _value(node.test), _nodes(node.yes, masked), _nodes(node.no, masked)
        return lambda env, turns: (yes if test(env) else no)(env, turns)
    if isinstance(node, Generation):
        return _nodes(node.body, True)
    body = _nodes(node.body, masked)

    def loop(env, turns):
        for i, (role, text) in enumerate(turns):
            yield from body({"role": role, "text": text, "index": i}, ())
            yield TURN_END
    return loop


def compile_template(source: str) -> Callable[[Iterable[tuple[str, str]]], Iterator]:
    """``render(turns)`` yields ``(text, under the loss mask)`` pairs, and
    TURN_END after each turn."""
    run = _nodes(fold(parse(source)), False)
    return lambda turns: run({}, turns)


# --- Spark -------------------------------------------------------------------------

SEGMENT = 1 << 20
FORMATTED = "conv_id long, segment long, text string, spans array<struct<begin: int, end: int>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _conversations(batches: Iterator[pa.RecordBatch]):
    """(conv_id, iterator of its rows) for rows that come sorted by conv_id."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def own(conv=conv):
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                row, ahead = ahead, next(rows, None)
                yield row
        part = own()
        yield conv, part
        for _ in part:                  # whatever the template did not take
            pass


def format_conversations(turns: DataFrame, template: str = DEFAULT) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to formatted text: conv_id,
    segment, text, spans (code points under the loss mask).

    A conversation is rendered in the order of turn (ties: role, text); its
    text is cut at turn borders into segments of about SEGMENT characters, so
    a task holds one segment, however long the conversation.  Null role or
    text count as empty, a null turn comes first, rows without conv_id are one
    conversation, repeated rows are turns of their own; an empty table gives an
    empty result.  Other columns are ignored.
    """
    compile_template(template)          # refuse a bad template here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), _SPANS),
                                                strict=True)], names=["conv_id", "segment", "text", "spans"])

        for conv, own in _conversations(batches):
            parts, spans, at, segment = [], [], 0, 0
            for piece in render((role or "", text or "") for _, role, text in own):
                if piece is TURN_END:
                    if at < SEGMENT:
                        continue
                    rows.append((conv, segment, "".join(parts), spans))
                    held, segment = held + at, segment + 1
                    parts, spans, at = [], [], 0
                    yield flush()
                    rows, held = [], 0
                    continue
                text, masked = piece
                if masked:
                    spans.append({"begin": at, "end": at + len(text)})
                parts.append(text)
                at += len(text)
            if at or not segment:
                rows.append((conv, segment, "".join(parts), spans))
                held += at
            if held > SEGMENT or len(rows) >= 5000:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    ordered = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                            F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
               .select("conv_id", "role", "text"))
    return ordered.mapInArrow(run, FORMATTED)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted segment; raises where it is not one."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: n_turns,
    turns_sha256 (role, newline, text, newline per turn), loss_chars and
    loss_sha256 (all text under the mask, unescaped), formatted_chars.  Hashing
    runs along the segments, so memory stays bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for conv, own in _conversations(batches):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, text, spans in own:
                chars += len(text)
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n_turns += 1
                for s in spans:
                    said = unescape(text[s["begin"]:s["end"]])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    loss_chars += len(said)
            rows.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(rows) >= 5000:
                yield _digest_batch(rows)
                rows = []
        if rows:
            yield _digest_batch(rows)

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
            .select("conv_id", "text", "spans").mapInArrow(run, DIGESTS))


def _digest_batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                             "formatted_chars"])


def format_and_read_back(turns: DataFrame, template: str = DEFAULT) -> DataFrame:
    """Format, store, and digest what was stored."""
    return digests(written(format_conversations(turns, template), "formatted"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS r,
             replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(13 + length(replace(r, chr(10), '\' || chr(10))) + length(t))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
