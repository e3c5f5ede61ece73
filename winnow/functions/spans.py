"""Where in a text a match is: spans in code points, worked out in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def sanitised(find: Callable[[str], object], text: str) -> list[dict] | None:
    """The spans that ``find`` gives, in order and without those that make no sense; None if none are left or it fails."""
    try:
        spans = [s for s in find(text) or () if isinstance(s, (tuple, list)) and len(s) == 2]
    except Exception:  # noqa: BLE001 - a custom type's function; the match itself stands
        return None
    real = [s for s in spans if all(isinstance(x, int) and not isinstance(x, bool) for x in s) and 0 <= s[0] < s[1] <= len(text)]
    return [{"start": a, "end": b} for a, b in sorted(map(tuple, real))] or None


def all_spans(column: Column, find: Callable[[str], list[tuple[int, int]]] | None, many: bool, kind=None, operand=None, context=None) -> Column:
    """The spans that ``find`` gives for a text, or for each text of an array.

    Without ``find``: for each text of an array whether it matches, for types that can't be tested inside a lambda.
    """
    if find is None:
        test = _python_test(kind, operand, context)

        @F.arrow_udf("array<boolean>")
        def passes(lists: pa.Array) -> pa.Array:
            return pa.array([None if x is None else [t is not None and test(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.bool_()))

        return passes(column)

    def of(text: str | None) -> list[dict] | None:
        return None if text is None else sanitised(find, text)

    if many:

        @F.arrow_udf("array<array<struct<start:int,end:int>>>")
        def each(lists: pa.Array) -> pa.Array:
            return pa.array([None if x is None else [of(t) for t in x] for x in lists.to_pylist()], pa.list_(_SPANS))

        return each(column)

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([of(t) for t in texts.to_pylist()], _SPANS)

    return spans(column)


def _python_test(kind, operand, context) -> Callable[[str], bool]:
    """The test of a wildcard or regular expression on one text."""
    from winnow.functions import regex as rx
    from winnow.plans.tree import Glob

    if kind.name == "regex":
        code, lines = rx.program(rx.parse(operand.pattern, operand.flags)), "m" in operand.flags
        return lambda t: rx.search(code, t, 0, lines) is not None
    fold = (lambda s: s) if context.case_sensitive else str.lower
    tree = rx.Item("seq", items=[rx.Item("begin"), *(rx.Item("repeat", items=[rx.Item("set", [(0, rx.MAX_POINT)])]) if p is Glob.ANY else rx.Item("set", [(0, rx.MAX_POINT)]) if p is Glob.ONE else rx.Item("seq", items=[rx.Item("set", [(ord(c), ord(c))]) for c in fold(p)]) for p in operand), rx.Item("end")])
    code = rx.program(tree)
    return lambda t: rx.search(code, fold(t)) is not None
