"""Limits of queries and trees. Fixed values of the language."""

import sys
from collections.abc import Iterator
from contextlib import contextmanager

MAX_DEPTH = 200
MAX_CLAUSES = 2000
MAX_AST_DEPTH = 2200
MAX_AST_NODES = 500_000
MAX_FIELD_SEGMENTS = 32
MAX_WILDCARD_SEGMENTS = 512
MAX_PATTERN_LENGTH = 1000
#: Sources up to this length can't expand beyond MAX_AST_NODES.
SHORT_SOURCE = 15_625


@contextmanager
def deep_recursion() -> Iterator[None]:
    """Room for recursion over trees of MAX_DEPTH levels, several calls a level.

    The limit is the interpreter's: it is raised once and stays, since lowering it again could fail another thread that
    is deep in a tree of its own.
    """
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    yield
