"""Functions that build trees, each checked as it is built."""

from __future__ import annotations

from winnow.plans.parser import scan_pattern
from winnow.plans.tree import Bound, Empty, Field, Group, Literal, Logical, Node, Range, Regex, Segment, Tag, Unary, Wildcard
from winnow.plans.validate import check_tree


def _checked(node: Node) -> Node:
    check_tree(node)
    return node


def term(value: str) -> Literal:
    return _checked(Literal(value))


def quoted(value: str) -> Literal:
    return _checked(Literal(value, True))


def boolean(value: bool) -> Literal:
    return Literal(bool(value))


def null() -> Literal:
    return Literal(None)


def wildcard(pattern: str, in_quotes: bool = False) -> Wildcard | Literal:
    """``pattern`` as a query spells it; without ``*`` and ``?`` it is plain text."""
    found = scan_pattern(pattern)
    return _checked(Literal(found, in_quotes) if isinstance(found, str) else Wildcard(found, in_quotes))


def regex(pattern: str, flags: str = "") -> Regex:
    return _checked(Regex(pattern, "".join(flags)))


def field(*path: str) -> Field:
    """A path; a segment with a dot in it is one key, so it is quoted."""
    return Field(tuple(Segment(name, not name or "." in name) for name in path))


def tag(path: Field, expression: Node, case_sensitive: bool = False) -> Tag:
    return _checked(Tag(path, ":", expression, case_sensitive))


def compare(path: Field, operator: str, expression: Literal, case_sensitive: bool = False) -> Tag:
    return _checked(Tag(path, operator, expression, case_sensitive))


def range_(lower: Literal | None, lower_inclusive: bool, upper: Literal | None, upper_inclusive: bool) -> Range:
    return _checked(Range(Bound(lower, lower_inclusive), Bound(upper, upper_inclusive)))


def and_(left: Node, right: Node, implicit: bool = False) -> Logical:
    return _checked(Logical("AND", left, right, implicit))


def or_(left: Node, right: Node) -> Logical:
    return _checked(Logical("OR", left, right))


def not_(operand: Node, operator: str = "NOT") -> Unary:
    return _checked(Unary(operator, operand))


def group(expression: Node) -> Group:
    return _checked(Group(expression))


field_group = group


def empty() -> Empty:
    return Empty()
