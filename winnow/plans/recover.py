"""What becomes of the holes of a tolerant parse before it runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from winnow.plans.errors import QueryError, RecoveredQueryError
from winnow.plans.tree import Empty, Group, Logical, Missing, Node, Range, Recovered, Tag, Unary, children


def _bounds_open(node: Range) -> bool:
    return any(b.recovered is not None for b in (node.lower, node.upper))


def _without_holes(node: Node) -> Node | None:
    match node:
        case Missing():
            return None
        case Range():
            return None if _bounds_open(node) else node
        case Tag(expression=inner):
            kept = _without_holes(inner)
            return kept and replace(node, expression=kept)
        case Group(expression=inner):
            kept = _without_holes(inner)
            return kept and replace(node, expression=kept)
        case Unary(operand=inner):
            kept = _without_holes(inner)
            return kept and replace(node, operand=kept)
    return node


def map_leaves(node: Node, change: Callable[[Node], Node | None]) -> Node | None:
    """``node`` with each operand of its AND/OR spines changed; None takes an operand out. Spines need no recursion."""
    spine = []
    while isinstance(node, Logical):
        spine.append(node)
        node = node.left
    left = _below(node, change)
    for top in reversed(spine):
        right = map_leaves(top.right, change)
        left = right if left is None else left if right is None else replace(top, left=left, right=right)
    return left


def _below(node: Node, change: Callable[[Node], Node | None]) -> Node | None:
    match node:
        case Group(expression=inner):
            kept = map_leaves(inner, change)
            return kept and replace(node, expression=kept)
        case Unary(operand=inner):
            kept = map_leaves(inner, change)
            return kept and replace(node, operand=kept)
        case Tag(expression=Group() as inner):
            kept = map_leaves(inner, change)
            return kept and replace(node, expression=kept)
    return change(node)


def prune(tree: Node) -> Node:
    """``tree`` without holes: a clause without its value goes, and so does what only held such clauses."""
    return map_leaves(tree, _without_holes) or Empty()


def first_recovered(tree: Node) -> Node | None:
    stack = [tree]
    while stack:
        node = stack.pop()
        if node.recovered:
            return node
        stack += reversed(list(children(node)))
    return None


def refuse_recovered(tree: Node) -> None:
    if node := first_recovered(tree):
        raise RecoveredQueryError(f"The query was mended ({node.recovered.reason}) and may not mean what was typed", span=node.location, reason=node.recovered.reason)


def repair(tree: Node, compiles: Callable[[Node], object]) -> Node:
    """Operands that can't be resolved become holes, clause by clause; only tried when the whole doesn't compile."""

    def tried(node: Node, path: Tag | None = None) -> Node | None:
        try:
            compiles(node)
            return node
        except QueryError:
            return Missing(location=node.location, recovered=Recovered("missing-value", True))

    try:
        compiles(tree)
        return tree
    except QueryError:
        return map_leaves(tree, tried)
