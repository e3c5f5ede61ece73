"""Checks of arguments and of trees that were built by hand."""

from __future__ import annotations

from winnow.plans import limits
from winnow.plans.errors import ArgumentError
from winnow.plans.tree import Bound, Empty, Field, Glob, Group, Literal, Logical, Missing, Node, Range, Regex, Segment, Tag, Unary, Wildcard, children, is_node


def check_query(source: object) -> None:
    if not isinstance(source, str):
        raise ArgumentError(f"A query is text, not {type(source).__name__}", argument="query")


def _complain(node: Node, why: str) -> None:
    raise ArgumentError(f"{node.TYPE}: {why}", argument="tree")


def _shape(node: Node, grouped: bool) -> None:
    match node:
        case Literal(value=value):
            if not (value is None or isinstance(value, (str, bool))):
                _complain(node, "a literal is text, a boolean or null")
            if node.quoted and not isinstance(value, str):
                _complain(node, "only text can be quoted")
        case Wildcard(pattern=pattern):
            if not pattern or not all(isinstance(p, (str, Glob)) for p in pattern):
                _complain(node, "a pattern is a tuple of text and Glob pieces")
            if len(pattern) > limits.MAX_WILDCARD_SEGMENTS:
                _complain(node, f"more than {limits.MAX_WILDCARD_SEGMENTS} segments")
        case Regex(pattern=pattern, flags=flags):
            if not isinstance(pattern, str) or len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
                _complain(node, "a regular expression has a pattern and distinct flags of dgimsuvy")
        case Bound(value=value):
            if value is not None and not (isinstance(value, Literal) and value.kind == "text"):
                _complain(node, "a bound is a text literal or open")
        case Field(segments=segments):
            if not 0 < len(segments) <= limits.MAX_FIELD_SEGMENTS or not all(isinstance(s, Segment) and isinstance(s.name, str) for s in segments):
                _complain(node, f"a path has 1 to {limits.MAX_FIELD_SEGMENTS} named segments")
        case Tag(operator=operator, expression=inner):
            if grouped:
                _complain(node, "a field group holds no other field")
            if operator not in (":", ":=", ":>", ":>=", ":<", ":<="):
                _complain(node, f"no operator {operator!r}")
            if operator != ":" and not isinstance(inner, (Literal, Missing)):
                _complain(node, "an operator that compares takes one literal")
            if not isinstance(inner, (Literal, Wildcard, Regex, Range, Group, Missing)) or not isinstance(node.field, Field):
                _complain(node, "no such value")
        case Logical(operator=operator):
            if operator not in ("AND", "OR") or node.implicit and operator != "AND":
                _complain(node, "joins by AND or OR, and only AND may be implicit")
        case Unary(operator=operator):
            if operator not in ("NOT", "-"):
                _complain(node, f"no operator {operator!r}")


def check_tree(tree: object) -> None:
    """Raises an ArgumentError unless ``tree`` is one that the engine takes: its shapes, its depth and its size."""
    if not is_node(tree):
        raise ArgumentError(f"A query is text or a syntax tree, not {type(tree).__name__}", argument="tree")
    stack, seen = [(tree, 0, False)], 0
    while stack:
        node, depth, grouped = stack.pop()
        seen += 1
        if seen > limits.MAX_AST_NODES:
            raise ArgumentError(f"This tree has more than {limits.MAX_AST_NODES} nodes")
        if depth > limits.MAX_AST_DEPTH:
            raise ArgumentError(f"This tree nests more than {limits.MAX_AST_DEPTH} levels deep")
        if not isinstance(node, Node) or isinstance(node, Empty) and depth:
            raise ArgumentError("An empty query is a tree of its own")
        _shape(node, grouped)
        for name in ("left", "right", "operand"):
            inner = getattr(node, name, None)
            if hasattr(node, name) and not is_node(inner):
                _complain(node, f"{name} is no expression")
        if isinstance(node, Group) and not is_node(node.expression):
            _complain(node, "no expression")
        below = grouped or isinstance(node, Tag) and isinstance(node.expression, Group)
        stack += [(c, depth + 1, below) for c in children(node)]
