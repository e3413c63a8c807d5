"""A boolean filter language over named fields, compiled to one Column.

``or`` binds weaker than ``and``, ``and`` weaker than ``not``. A field stands on the left, literals on the right. Comparison is two-valued: null equals null,
values of different types are unequal, ``not`` never meets an unknown.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from re import _parser as parser  # Python 3.11 and later
except ImportError:  # pragma: no cover
    import sre_parse as parser  # type: ignore[no-redef]

TOKENS = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<op>==|!=|<=|>=|<|>|\(|\)|\[|\]|,)|(?P<name>[A-Za-z_][\w.]*))"""
)
KEYWORDS = {"and", "or", "not", "in", "contains", "matches", "true", "false", "null"}
_REPEATS = {"MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"}


def repeats_a_repeat(pattern: str) -> bool:
    """Whether a repetition without bound stands inside another one, at any depth of the parsed pattern."""

    def inside(part: object, repeated: bool) -> bool:
        if isinstance(part, parser.SubPattern):
            return any(inside(x, repeated) for x in part.data)
        if isinstance(part, tuple) and len(part) == 2 and str(part[0]) in _REPEATS:
            _, most, body = part[1]
            endless = most is parser.MAXREPEAT
            return endless and repeated or inside(body, repeated or endless)
        return isinstance(part, (tuple, list)) and any(inside(x, repeated) for x in part)

    return inside(parser.parse(pattern), False)


class FilterError(ValueError):
    """The text of a filter is wrong, or does not fit the fields."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKENS.match(text, at)
        if not m:
            raise FilterError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        kind, raw, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind == "name" and raw.lower() in KEYWORDS:
            out.append(Token(raw.lower(), raw.lower(), m.start()))
        elif kind == "string":
            out.append(Token("literal", re.sub(r"\\(.)", r"\1", raw[1:-1]), m.start()))
        elif kind == "number":
            out.append(Token("literal", float(raw) if "." in raw else int(raw), m.start()))
        else:
            out.append(Token("op" if kind == "op" else kind, raw, m.start()))
    return out


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple


class _Parser:
    def __init__(self, text: str):
        self.all, self.at = tokens(text), 0

    def peek(self, *want: str) -> bool:
        t = self.all[self.at] if self.at < len(self.all) else None
        return t is not None and (t.kind in want or t.kind == "op" and t.value in want)

    def take(self, *want: str) -> Token:
        if not self.peek(*want):
            got = self.all[self.at].value if self.at < len(self.all) else "end of filter"
            raise FilterError(f"expected {' or '.join(want)}, found {got!r}")
        self.at += 1
        return self.all[self.at - 1]

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek("or"):
            self.take("or")
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self) -> Node:
        parts = [self.negated()]
        while self.peek("and"):
            self.take("and")
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def negated(self) -> Node:
        if self.peek("not"):
            self.take("not")
            return Node("not", (self.negated(),))
        if self.peek("("):
            self.take("(")
            inner = self.either()
            self.take(")")
            return inner
        field = self.take("name").value
        if self.peek("==", "!=", "<", "<=", ">", ">="):
            op = self.take("op").value
            return Node(op, (field, self.literal()))
        if self.peek("not"):
            self.take("not")
            self.take("in")
            return Node("not", (Node("in", (field, self.values())),))
        if self.peek("in"):
            self.take("in")
            return Node("in", (field, self.values()))
        if self.peek("contains", "matches"):
            op = self.take("contains", "matches").kind
            return Node(op, (field, self.literal()))
        return Node("truth", (field,))

    def values(self) -> tuple:
        self.take("[")
        out = []
        while not self.peek("]"):
            out.append(self.literal())
            if not self.peek("]"):
                self.take(",")
        self.take("]")
        return tuple(out)

    def literal(self):
        t = self.take("literal", "true", "false", "null")
        return {"true": True, "false": False, "null": None}[t.kind] if t.kind != "literal" else t.value


def parse(text: str) -> Node:
    p = _Parser(text)
    node = p.either()
    if p.at < len(p.all):
        raise FilterError(f"unexpected {p.all[p.at].value!r}")
    return node


def fields_of(node: Node) -> set[str]:
    """Names of the fields a filter reads; joins that only supply other fields can be left out."""
    if node.op in ("and", "or", "not"):
        return set().union(*(fields_of(a) for a in node.args))
    return {node.args[0]}


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    return {T.StringType: "string", T.BooleanType: "number", T.ArrayType: "list", T.TimestampType: "time", T.DateType: "time"}.get(type(kind), "other")


def _literal_family(v: object) -> str:
    return "null" if v is None else "number" if isinstance(v, (bool, int, float)) else "string"


class Compiler:
    """Compiles filters over the columns of ``df``; ``resolver`` gives other names for expressions. lenient: order comparisons with null are false instead of an error."""

    def __init__(self, df: DataFrame, resolver: Mapping[str, Column] | None = None, lenient: bool = False):
        self.columns = {n: F.col(n) for n in df.columns} | dict(resolver or {})
        view = df.select(*[c.alias(n) for n, c in self.columns.items()])
        self.kinds = {f.name: f.dataType for f in view.schema.fields}
        self.lenient = lenient

    def column(self, name: str) -> tuple[Column, str]:
        if name not in self.columns:
            raise FilterError(f"unknown field {name!r}")
        kind = self.kinds[name]
        c = self.columns[name]
        return (c.cast("int") if isinstance(kind, T.BooleanType) else c), _family(kind)

    def equal(self, name: str, value: object) -> Column:
        c, family = self.column(name)
        if value is None:
            return c.isNull()
        if _literal_family(value) != family and not (family == "time" and isinstance(value, str)):
            return F.lit(False)
        return c.eqNullSafe(F.lit(int(value) if isinstance(value, bool) else value))

    def compile(self, node: Node) -> Column:
        op, a = node.op, node.args
        if op in ("and", "or"):
            out = self.compile(a[0])
            for x in a[1:]:
                out = out & self.compile(x) if op == "and" else out | self.compile(x)
            return out
        if op == "not":
            return ~self.compile(a[0])
        if op == "==":
            return self.equal(*a)
        if op == "!=":
            return ~self.equal(*a)
        if op == "in":
            out = F.lit(False)
            for v in a[1]:
                out = out | self.equal(a[0], v)
            return out
        c, family = self.column(a[0])
        if op == "truth":
            truth = {"number": c != 0, "string": c != "", "list": F.size(c) > 0}.get(family, c.isNotNull())
            return F.coalesce(truth, F.lit(False))
        value = a[1]
        if op == "contains":
            if family == "string" and isinstance(value, str):
                return F.coalesce(F.contains(F.lower(c), F.lit(value.lower())), F.lit(False))
            if family == "list":
                return F.coalesce(F.array_contains(c, F.lit(value)), F.lit(False))
            raise FilterError(f"{a[0]!r} can contain nothing of that kind")
        if op == "matches":
            if family != "string" or not isinstance(value, str):
                raise FilterError("matches needs a text field and a pattern")
            try:
                re.compile(value)
            except re.error as e:
                raise FilterError(f"not a pattern: {e}") from e
            if repeats_a_repeat(value):
                raise FilterError("the pattern repeats a repetition without bound")
            return F.coalesce(c.rlike(value), F.lit(False))
        if value is None or _literal_family(value) != family and not (family == "time" and isinstance(value, str)):
            raise FilterError(f"{a[0]!r} cannot be ordered against {value!r}")
        v = F.lit(int(value) if isinstance(value, bool) else value)
        order = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]
        if self.lenient:
            return F.coalesce(order, F.lit(False))
        return F.when(c.isNull(), F.raise_error(F.lit(f"{a[0]}: null cannot be ordered")).cast("boolean")).otherwise(order)


def where(df: DataFrame, text: str, resolver: Mapping[str, Column] | None = None, lenient: bool = True) -> DataFrame:
    """The rows of ``df`` that a filter keeps."""
    return df.where(Compiler(df, resolver, lenient).compile(parse(text)))
