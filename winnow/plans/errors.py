"""The errors of the query engine, each with a code of the language's vocabulary."""

from __future__ import annotations

from typing import NamedTuple


class Span(NamedTuple):
    """A range of the query's text: offsets in characters, end exclusive."""

    start: int
    end: int


class QueryError(Exception):
    """What every error of this engine is."""

    code = "ARGUMENT"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details


class SyntaxError_(QueryError):
    """The query can't be parsed; the message shows where."""

    code = "SYNTAX"

    def __init__(self, message: str, span: Span, source: str, expected: tuple[str, ...] = (), code: str = "SYNTAX"):
        begin = source.rfind("\n", 0, span.start) + 1
        line = source[begin:].split("\n", 1)[0]
        marks = " " * (span.start - begin) + "^" * max(1, min(span.end, begin + len(line)) - span.start)
        super().__init__(f"{message}\n  {line}\n  {marks}", span=span, source=source, expected=expected)
        self.code, self.span, self.source, self.expected, self.reason = code, span, source, expected, message


class OperandError(QueryError):
    """An operand can't be what its clause needs: OPERAND, UNORDERED_TYPE, MIXED_RANGE_TYPES or UNSAFE_PATTERN."""

    def __init__(self, message: str, code: str = "OPERAND", **details):
        super().__init__(message, **details)
        self.code = code


class ValueError_(QueryError):
    """A row's value can't be read as the clause's type, and the policy is to raise."""

    code = "VALUE"


class RecoveredQueryError(QueryError):
    code = "RECOVERED"


class ConfigError(QueryError):
    code = "CONFIG"


class DateFormatError(ConfigError):
    """A date layout is not one."""


class ArgumentError(QueryError):
    code = "ARGUMENT"


def is_query_error(value: object) -> bool:
    return isinstance(value, QueryError)
