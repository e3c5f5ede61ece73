"""The syntax tree: frozen nodes that compare without places, and their JSON form.

Numbers and dates stay text here; what an operand means is decided when a query meets a schema.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace
from enum import Enum
from types import MappingProxyType
from typing import ClassVar, NamedTuple

from winnow.plans.errors import ArgumentError, Span

SYNTHETIC = Span(0, 0)
KEYWORD_LITERALS = frozenset({"true", "false", "null"})
RESERVED_WORDS = frozenset({"AND", "OR", "NOT", "TO"})
RESERVED_CHARACTERS = frozenset(" \t\n\r\f\v():\"'\\/[]{}<>=^~*?")
OPERATOR_PRECEDENCE = MappingProxyType({"NOT": 30, "-": 30, "AND": 20, "OR": 10})
ORDERINGS = (":>=", ":<=", ":>", ":<")
#: Why a tolerant parse had to mend a query.
RECOVERY_REASONS = (
    "unterminated-quote", "unterminated-regex", "unclosed-group", "unclosed-range", "missing-value",
    "missing-operand", "unsupported-modifier", "trailing-input", "stray-input",
)


class Recovered(NamedTuple):
    reason: str
    #: Whether the node stands for something that isn't in the query at all.
    synthetic: bool = False


class Modifiers(NamedTuple):
    """Reserved syntax that trees may carry and the parser refuses."""

    boost: str | None = None
    fuzzy: str | None = None
    proximity: str | None = None
    required: bool = False


class Glob(Enum):
    """The pieces of a wildcard pattern that aren't literal text."""

    ANY = "*"
    ONE = "?"


@dataclass(frozen=True)
class Node:
    TYPE: ClassVar[str] = ""
    location: Span = field(default=SYNTHETIC, compare=False, kw_only=True)
    recovered: Recovered | None = field(default=None, kw_only=True)
    modifiers: Modifiers | None = field(default=None, kw_only=True)


@dataclass(frozen=True)
class Empty(Node):
    TYPE = "EmptyExpression"


@dataclass(frozen=True)
class Missing(Node):
    TYPE = "MissingExpression"


@dataclass(frozen=True)
class Literal(Node):
    TYPE = "LiteralExpression"
    value: str | bool | None
    quoted: bool = False

    @property
    def kind(self) -> str:
        return "null" if self.value is None else "boolean" if isinstance(self.value, bool) else "text"


@dataclass(frozen=True)
class Wildcard(Node):
    TYPE = "WildcardExpression"
    pattern: tuple[str | Glob, ...]
    quoted: bool = False


@dataclass(frozen=True)
class Regex(Node):
    TYPE = "RegexExpression"
    pattern: str
    flags: str = ""


@dataclass(frozen=True)
class Bound(Node):
    """One side of a range; without a value it is open."""

    TYPE = "RangeBoundary"
    value: Literal | None = None
    inclusive: bool = True


@dataclass(frozen=True)
class Range(Node):
    TYPE = "RangeExpression"
    lower: Bound
    upper: Bound


@dataclass(frozen=True)
class Segment(Node):
    TYPE = "FieldSegment"
    name: str
    quoted: bool = False


@dataclass(frozen=True)
class Field(Node):
    TYPE = "Field"
    segments: tuple[Segment, ...]


@dataclass(frozen=True)
class Tag(Node):
    """``field operator expression``; operator is ``:`` for a match and else one that compares with one value."""

    TYPE = "Tag"
    field: Field
    operator: str
    expression: Node
    case_sensitive: bool = False


@dataclass(frozen=True)
class Logical(Node):
    TYPE = "LogicalExpression"
    operator: str
    left: Node
    right: Node
    implicit: bool = False


@dataclass(frozen=True)
class Unary(Node):
    TYPE = "UnaryOperator"
    operator: str
    operand: Node


@dataclass(frozen=True)
class Group(Node):
    TYPE = "ParenthesizedExpression"
    expression: Node


ROOT_NODES = (Empty, Missing, Literal, Wildcard, Regex, Range, Tag, Logical, Unary, Group)
ROOT_NODE_TYPES = frozenset(n.TYPE for n in ROOT_NODES)
_BY_TYPE = {n.TYPE: n for n in (*ROOT_NODES, Bound, Segment, Field)}


def is_node(value: object) -> bool:
    return isinstance(value, ROOT_NODES)


def field_path(path: Field) -> tuple[str, ...]:
    return tuple(s.name for s in path.segments)


def field_name(path: Field) -> str:
    return ".".join(field_path(path))


def range_bracket(side: str, bound: Bound) -> str:
    closed = bound.value is None or bound.inclusive
    return ("[" if closed else "{") if side == "lower" else ("]" if closed else "}")


def is_safe_unquoted(text: str) -> bool:
    """Whether ``text`` can stand in a query as it is."""
    return bool(text) and text not in RESERVED_WORDS | KEYWORD_LITERALS and text[0] not in "+-" and not RESERVED_CHARACTERS & set(text)


def operands(node: Logical) -> Iterator[Node]:
    """What a run of one operator joins, in order; the spine is walked, however long, without recursion."""
    stack: list[Node] = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, Logical) and top.operator == node.operator:
            stack += [top.right, top.left]
        else:
            yield top


def children(node: Node) -> Iterator[Node]:
    for f in fields(node):
        value = getattr(node, f.name)
        if isinstance(value, Node):
            yield value
        elif f.name == "segments":
            yield from value


_CAMEL = {"case_sensitive": "caseSensitive"}


def to_dict(node: Node) -> dict:
    """The JSON form; a spine of any length is built without recursion."""
    done: dict[int, dict] = {}
    stack = [(node, False)]
    while stack:
        top, ready = stack.pop()
        if not ready:
            stack += [(top, True), *((c, False) for c in children(top))]
            continue
        out: dict = {"type": top.TYPE}
        for f in fields(top):
            value = getattr(top, f.name)
            if f.name in ("recovered", "modifiers"):
                if value is not None:
                    out[f.name] = value._asdict()
            elif f.name == "location":
                out["location"] = value._asdict()
            elif f.name == "pattern" and isinstance(top, Wildcard):
                out["pattern"] = [{"type": "WildcardAny"} if p is Glob.ANY else {"type": "WildcardSingle"} if p is Glob.ONE else {"type": "WildcardLiteral", "value": p} for p in value]
            elif isinstance(value, Node):
                out[f.name] = done[id(value)]
            elif f.name == "segments":
                out["segments"] = [done[id(s)] for s in value]
            else:
                out[_CAMEL.get(f.name, f.name)] = value
        done[id(top)] = out
    return done[id(node)]


def from_dict(data: dict) -> Node:
    """The node that :func:`to_dict` describes; anything else is an ArgumentError."""
    try:
        done: dict[int, Node] = {}
        stack = [(data, False)]
        while stack:
            top, ready = stack.pop()
            inner = [v for v in top.values() if isinstance(v, dict) and v.get("type") in _BY_TYPE] + [v for v in top.get("segments", [])]
            if not ready:
                stack += [(top, True), *((v, False) for v in inner)]
                continue
            kind, args = _BY_TYPE[top["type"]], {}
            for f in fields(kind):
                key = _CAMEL.get(f.name, f.name)
                if key not in top:
                    continue
                value = top[key]
                if f.name == "location":
                    value = Span(**value)
                elif f.name == "recovered":
                    value = Recovered(**value)
                elif f.name == "modifiers":
                    value = Modifiers(**value)
                elif f.name == "segments":
                    value = tuple(done[id(v)] for v in value)
                elif f.name == "pattern" and kind is Wildcard:
                    value = tuple({"WildcardAny": Glob.ANY, "WildcardSingle": Glob.ONE}.get(p["type"]) or p["value"] for p in value)
                elif isinstance(value, dict):
                    value = done[id(value)]
                args[f.name] = value
            done[id(top)] = kind(**args)
        return done[id(data)]
    except (KeyError, TypeError, AttributeError) as e:
        raise ArgumentError(f"Not a syntax tree: {e!r}") from e


def marked(node: Node, reason: str) -> Node:
    """``node`` with a mark of recovery, unless it has one."""
    return node if node.recovered else replace(node, recovered=Recovered(reason))
