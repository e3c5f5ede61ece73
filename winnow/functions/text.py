"""String predicates over columns: globs and regular expressions that run in linear time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.functions import regex as rx
from winnow.plans.tree import Glob


def _asked(column: Column, test, many: bool) -> Column:
    """``test``, from an Arrow array of texts to one of booleans, of a text column or (many) of any text in an array."""

    @F.arrow_udf("boolean")
    def one(texts: pa.Array) -> pa.Array:
        return test(texts)

    @F.arrow_udf("boolean")
    def any_of(lists: pa.Array) -> pa.Array:
        out = np.zeros(len(lists), bool)
        hit = pc.fill_null(test(lists.flatten()), False)
        out[pc.list_parent_indices(lists).filter(hit).to_numpy()] = True
        return pa.array(out)

    return (any_of if many else one)(column)


def _arrow_match(column: Column, pattern: str, many: bool) -> Column:
    """Whether RE2 finds ``pattern``; batches go to Python as Arrow, never row by row."""
    return _asked(column, lambda texts: pc.match_substring_regex(texts, pattern), many)


def _each(text: Column, many: bool, test) -> Column:
    return F.exists(text, test) if many else test(text)


def glob(text: Column, pattern: tuple[str | Glob, ...], many: bool = False) -> Column:
    """Whether the whole of ``text`` (many: of any text in an array) has the pattern.

    Built-in expressions where they can say it, else RE2.
    """
    if Glob.ONE in pattern and not all(p is Glob.ONE for p in pattern):
        body = "".join({Glob.ANY: ".*", Glob.ONE: "."}.get(p) or re.sub(r"[^0-9A-Za-z]", lambda m: f"\\x{{{ord(m[0]):x}}}", p) for p in pattern)
        return _arrow_match(text, rf"(?s)\A{body}\z", many)
    return _each(text, many, lambda t: _glob(t, pattern))


def _glob(text: Column, pattern: tuple[str | Glob, ...]) -> Column:
    if pattern == (Glob.ANY,):
        return text.isNotNull()
    if all(p is Glob.ONE for p in pattern):
        return F.length(text) == len(pattern)
    literals = [p for p in pattern if isinstance(p, str)]
    opens, closes = isinstance(pattern[0], str), isinstance(pattern[-1], str)
    if len(pattern) == 1:
        return text == literals[0]
    if len(literals) == 1:
        return text.startswith(literals[0]) if opens else text.endswith(literals[0]) if closes else text.contains(literals[0])
    first, last = (literals[0] if opens else ""), (literals[-1] if closes else "")
    middle = literals[bool(opens) : len(literals) - bool(closes)]
    checks = []
    if opens:
        checks.append(text.startswith(first))
    if closes:
        checks += [text.endswith(last), F.length(text) >= sum(map(len, literals))]
    if middle:
        # Each piece at its leftmost place after the one before; a place of 0 once a piece is missing. Linear, and
        # exact. The text rides in the accumulator, so that folding it is paid once.
        start = F.struct(text.alias("text"), F.lit(1).alias("at"), F.lit(len(first)).alias("size"))
        place = lambda s, piece: F.when(s["at"] == 0, 0).otherwise(F.call_function("locate", piece, s["text"], s["at"] + s["size"]))
        step = lambda s, piece: F.struct(s["text"].alias("text"), place(s, piece).alias("at"), F.length(piece).alias("size"))
        fits = lambda s: (s["at"] > 0) & (s["at"] - 1 + s["size"] + len(last) <= F.length(s["text"]))
        checks.append(F.aggregate(F.array(*map(F.lit, middle)), start, step, fits))
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def regex_match(text: Column, pattern: str, flags: str = "", max_length: int | None = None, guard: bool = True, many: bool = False) -> Column:
    """Whether ``text`` (many: any text in an array) has the pattern anywhere. ``guard=False`` lets what the dialect refuses run on Python's engine."""
    try:
        tree = rx.parse(pattern, flags, max_length)
    except rx.OperandError:
        if guard:
            raise
        return _backtracking(text, pattern, flags, many)
    literal = rx.plain_text(tree)
    if literal is not None:
        return _each(text, many, lambda t: t.contains(literal) if literal else t.isNotNull())
    lines = "m" in flags
    try:
        re2 = rx.to_re2(tree, lines)
        pc.match_substring_regex(pa.array([""]), re2)
    except pa.ArrowInvalid:  # more memory than RE2 takes
        return _asked(text, lambda texts: _one_by_one(texts, rx.program(tree), lines), many)
    return _line_match(text, re2, rx.program(tree), many) if lines else _arrow_match(text, re2, many)


def _one_by_one(texts: pa.Array, code: list[tuple], lines: bool) -> pa.Array:
    return pa.array([None if t is None else rx.search(code, t, 0, lines) is not None for t in texts.to_pylist()], pa.bool_())


#: What ends a line besides a line feed, where RE2 sees no line's end.
_OTHER_LINE_ENDS = "[\r\u2028\u2029]"


def _line_match(text: Column, re2: str, code: list[tuple], many: bool) -> Column:
    """RE2 for texts whose lines all end by line feeds, and the virtual machine for the others alone."""

    def test(texts: pa.Array) -> pa.Array:
        odd = pc.fill_null(pc.match_substring_regex(texts, _OTHER_LINE_ENDS), False)
        hit = pc.match_substring_regex(texts, re2)
        return pc.replace_with_mask(hit, odd, _one_by_one(texts.filter(odd), code, True)) if pc.any(odd).as_py() else hit

    return _asked(text, test, many)


def _backtracking(text: Column, pattern: str, flags: str, many: bool) -> Column:
    try:
        own = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern), sum(f for c, f in (("i", re.I), ("m", re.M), ("s", re.S)) if c in flags))
    except re.error as e:
        raise rx.OperandError(f"Not a regular expression: {e}", "OPERAND") from e
    return _asked(text, lambda texts: pa.array([None if t is None else own.search(t) is not None for t in texts.to_pylist()], pa.bool_()), many)
